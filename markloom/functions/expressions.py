"""Policy logic as Catalyst expressions, on plain columns and on parsed attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .facts import SPACE_CLASS
from .fixed import ALLOWED_SCHEMES, NO_END_TAG, RAW_TEXT, UNSAFE_PROPERTIES, URL_ATTRIBUTES
from .policy import Policy

NBSP = "\xa0"


def _replace(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_text(c: Column) -> Column:
    return _replace(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (NBSP, "&nbsp;")))


def escape_attribute(c: Column) -> Column:
    return _replace(c, (("&", "&amp;"), ('"', "&quot;"), (NBSP, "&nbsp;")))


def is_event_handler(name: Column) -> Column:
    return name.startswith("on")


def is_url_attribute(name: Column) -> Column:
    return name.isin(*sorted(URL_ATTRIBUTES))


def scheme_of(url: Column) -> Column:
    """Lower-cased scheme of a URL without disguises (white space or controls in its scheme); null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z0-9+.\-]+):", 1))
    return F.when(found != "", found)


def dangerous_scheme(scheme: Column, data_image: Column) -> Column:
    return F.coalesce(scheme.isin("javascript", "vbscript") | ((scheme == "data") & ~data_image), F.lit(False))


def dangerous_url(url: Column) -> Column:
    """For URLs whose scheme is not disguised; the parse's facts cover the others."""
    return dangerous_scheme(scheme_of(url), F.lower(F.substring(url, 1, 11)) == "data:image/")


def unsafe_css_value(v: Column) -> Column:
    squeezed = F.translate(F.lower(F.regexp_replace(v, SPACE_CLASS, "")), "\"'", "")
    return (
        v.rlike(r"[\x00-\x1f]")
        | squeezed.contains("expression(") | squeezed.contains("javascript:") | squeezed.contains("vbscript:")
        | (squeezed.contains("url(data:") & ~squeezed.contains("url(data:image/"))
    )


def safe_declarations(decls: Column) -> Column:
    """Parsed style declarations back to a string, without the unsafe ones."""
    safe = F.filter(decls, lambda d: ~d["prop"].isin(*sorted(UNSAFE_PROPERTIES)) & ~unsafe_css_value(d["val"]))
    return F.array_join(F.transform(safe, lambda d: F.concat(d["prop"], F.lit(": "), d["val"])), "; ")


def attribute_reason(attr: Column, allowed: Column, policy: Policy) -> Column:
    """Why an attribute goes or is rewritten; null where it stays as it is."""
    reason = F.when(~F.coalesce(F.array_contains(allowed, attr["name"]), F.lit(False)), "not-allowed")
    if policy.allow_unsafe:
        return reason
    style = safe_declarations(F.coalesce(attr["style_decls"], F.array()))
    return (
        reason.when(is_event_handler(attr["name"]), "event-handler")
        .when(is_url_attribute(attr["name"]) & dangerous_scheme(attr["url_scheme"], attr["url_data_image"]), "dangerous-url")
        .when((attr["name"] == "style") & (style == ""), "unsafe-css")
        .when((attr["name"] == "style") & (style != attr["value"]), "unsafe-css-declaration")
    )


def allowed_map(policy: Policy) -> Column:
    """tag -> array of its attributes, those of ``*`` included, for the tags a policy keeps."""
    pairs = []
    for tag in sorted(policy.kept_tags()):
        names = sorted(policy.allowed(tag))
        pairs += [F.lit(tag), F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,array<string>>")


def _one_of(c: Column, names) -> Column:  # noqa: ANN001
    names = sorted(names)
    return F.coalesce(c.isin(*names), F.lit(False)) if names else F.lit(False)


def shown(event: Column, policy: Policy) -> Column:
    """Not inside an element that takes its content with it, nor such an element itself."""
    hidden = event["anc_mask"].bitwiseAND(F.lit(policy.drop_mask).cast("long")) != 0
    return ~hidden


def rendered(event: Column, policy: Policy) -> Column:
    """One event as HTML under a policy, as the empty string if nothing of it shows."""
    kept = _one_of(event["name"], policy.kept_tags())
    allowed = allowed_map(policy)[event["name"]]
    stay = F.filter(F.coalesce(event["attrs"], F.array()), lambda a: F.coalesce(~attribute_reason(a, allowed, policy).isin(
        "not-allowed", "event-handler", "dangerous-url", "unsafe-css"), F.lit(True)))

    def pair(a: Column) -> Column:
        value = a["value"]
        if not policy.allow_unsafe:
            value = F.when(a["name"] == "style", safe_declarations(F.coalesce(a["style_decls"], F.array()))).otherwise(value)
        return F.concat(F.lit(" "), F.regexp_replace(a["name"], "^([^ ]*) ", "$1:"), F.lit('="'), escape_attribute(value), F.lit('"'))

    tag = F.concat(F.lit("<"), event["name"], F.array_join(F.transform(stay, pair), ""), F.lit(">"))
    raw = _one_of(event["parent_name"], policy.kept_tags() & RAW_TEXT)
    return (
        F.when(event["kind"] == "text", F.when(raw, event["value"]).otherwise(escape_text(event["value"])))
        .when((event["kind"] == "open") & kept, tag)
        .when((event["kind"] == "close") & kept & ~_one_of(event["name"], NO_END_TAG), F.concat(F.lit("</"), event["name"], F.lit(">")))
        .otherwise("")
    )


def sanitized_html(events: Column, policy: Policy) -> Column:
    """An array of events as sanitized HTML; no Python, so a new policy parses nothing anew."""
    seen = F.filter(events, lambda e: shown(e, policy))
    return F.array_join(F.transform(seen, lambda e: rendered(e, policy)), "")


def removals(events: Column, policy: Policy) -> Column:
    """Array of (kind, name, reason) of what a policy takes out, in document order."""
    kept, dropped = sorted(policy.kept_tags()), sorted(policy.drops())
    amap = allowed_map(policy)

    def of(e: Column) -> Column:
        tag = (
            F.when(_one_of(e["name"], dropped), "unsafe-element")
            .when(~_one_of(e["name"], kept) & ~e["name"].isin("html", "head", "body"), "not-allowed")
        )
        own = F.when(tag.isNotNull(), F.array(F.struct(F.lit("tag").alias("kind"), e["name"].alias("name"), tag.alias("reason"))))
        gone = F.transform(F.coalesce(e["attrs"], F.array()), lambda a: F.struct(a["name"].alias("name"), attribute_reason(a, amap[e["name"]], policy).alias("reason")))
        kind = lambda r: F.when(r == "dangerous-url", "url").when(r.startswith("unsafe-css"), "style").otherwise("attr")
        listed = F.transform(F.filter(gone, lambda g: g["reason"].isNotNull()), lambda g: F.struct(kind(g["reason"]).alias("kind"), g["name"].alias("name"), g["reason"].alias("reason")))
        return F.when(_one_of(e["name"], kept), listed).otherwise(F.coalesce(own, F.array().cast("array<struct<kind:string,name:string,reason:string>>")))

    opens = F.filter(events, lambda e: (e["kind"] == "open") & shown(e, policy))
    return F.flatten(F.transform(opens, of))


def visible_text(events: Column) -> Column:
    """Text outside raw-text elements."""
    from .policy import mask_of

    raw = mask_of(RAW_TEXT)
    seen = F.filter(events, lambda e: (e["kind"] == "text") & (e["anc_mask"].bitwiseAND(F.lit(raw).cast("long")) == 0))
    return F.array_join(F.transform(seen, lambda e: e["value"]), "")


def serialized_html(events: Column, node_id: Column | None = None) -> Column:
    """The document, or the subtree of one node, as HTML without any policy."""
    if node_id is not None:
        at = F.filter(events, lambda e: (e["node_id"] == node_id) & (e["kind"] != "close"))[0]
        events = F.filter(events, lambda e: (e["seq"] >= at["seq"]) & (e["seq"] <= at["exit_seq"]))

    def pair(a: Column) -> Column:
        return F.concat(F.lit(" "), F.regexp_replace(a["name"], "^([^ ]*) ", "$1:"), F.lit('="'), escape_attribute(a["value"]), F.lit('"'))

    def one(e: Column) -> Column:
        raw = _one_of(e["parent_name"], RAW_TEXT)
        if node_id is not None:  # a text node by itself is escaped
            raw = raw & (e["node_id"] != node_id)
        return (
            F.when(e["kind"] == "text", F.when(raw, e["value"]).otherwise(escape_text(e["value"])))
            .when(e["kind"] == "comment", F.concat(F.lit("<!--"), e["value"], F.lit("-->")))
            .when(e["kind"] == "doctype", F.concat(F.lit("<!DOCTYPE "), F.coalesce(e["name"], F.lit("")), F.lit(">")))
            .when(e["kind"] == "open", F.concat(F.lit("<"), e["name"], F.array_join(F.transform(F.coalesce(e["attrs"], F.array()), pair), ""), F.lit(">")))
            .when((e["kind"] == "close") & ~_one_of(e["name"], NO_END_TAG), F.concat(F.lit("</"), e["name"], F.lit(">")))
            .otherwise("")
        )

    from .policy import mask_of

    seen = F.filter(events, lambda e: e["anc_mask"].bitwiseAND(F.lit(mask_of(NO_END_TAG)).cast("long")) == 0)
    return F.array_join(F.transform(seen, one), "")


def element_text(events: Column, node_id: Column) -> Column:
    """All text below a node, raw text too; its own if it is a text node."""
    at = F.filter(events, lambda e: (e["node_id"] == node_id) & (e["kind"] != "close"))[0]
    inside = F.filter(events, lambda e: (e["kind"] == "text") & (e["seq"] >= at["seq"]) & (e["seq"] <= at["exit_seq"]))
    return F.array_join(F.transform(inside, lambda e: e["value"]), "")


def harmful_scheme(url: Column, schemes=ALLOWED_SCHEMES, protocol_relative: bool = True) -> Column:  # noqa: ANN001
    """The lenient dialect's test: controls, spaces and HTML comments are taken out before the scheme is read."""
    s = F.regexp_replace(url, r"[\x00-\x20]+", "")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", "")
    scheme = F.lower(F.regexp_extract(s, r"^([a-zA-Z][a-zA-Z0-9.\-+]*):", 1))
    relative = s.rlike(r"^[/\\]{2}")
    return F.when(scheme != "", ~scheme.isin(*schemes)).when(relative, F.lit(not protocol_relative)).otherwise(F.lit(False))
