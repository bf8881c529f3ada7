"""Names that results depend on, as the HTML standard and the two dialects have them."""

from __future__ import annotations


def names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# --- Fixed values: tree construction ---

HEADING = names("h1 h2 h3 h4 h5 h6")
VOID = names("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
RAW = names("style xmp iframe noembed noframes")
IN_HEAD = names("base basefont bgsound link meta title noframes style script template head noscript command")
IMPLIED = names("dd dt li optgroup option p rb rp rt rtc")
STYLING = names("a b big code em font i nobr s small strike strong tt u")
SHUTS_BLOCK = names(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup"
    " listing main menu nav ol pre section summary ul"
)
OPENS_BLOCK = names(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main"
    " menu nav ol p pre section summary ul"
)
SPECIAL = names(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div"
    " dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input"
    " li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script section select"
    " source style summary table tbody td template textarea tfoot th thead title tr ul wbr xmp"
)
TABLE_PARTS = names("caption col colgroup tbody td tfoot th thead tr")
FOSTER = names("table tbody tfoot thead tr")
TO_TABLE = names("table template html")
TO_BODY = names("tbody tfoot thead template html")
TO_ROW = names("tr template html")
SCOPE = names("applet caption html marquee object table td template th")
MATH_TEXT = names("mi mn mo ms mtext")
SVG_HTML = names("desc foreignObject title")
BREAKOUT = names(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre"
    " ruby s small span strong strike sub sup table tt u ul var"
)
#: Names of SVG elements and attributes that are not all lower case.
SVG_TAGS = (
    "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer"
    " feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG"
    " feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile"
    " feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
)
SVG_ATTRIBUTES = (
    "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef"
    " gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle"
    " markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform"
    " patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur"
    " requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles"
    " surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector"
    " zoomAndPan"
)
#: Attributes with a prefix; a space parts it from the local name in the tree.
PREFIXED_ATTRIBUTES = (
    "xlink:actuate xlink:arcrole xlink:href xlink:role xlink:show xlink:title xlink:type xml:lang xml:space xmlns:xlink"
)

# --- Fixed values: the allow-list sanitizer ---

BASELINE_DROP = names("script")
#: Disallowed elements that take their content with them.
CONTENT_DROP = names("script style textarea option xmp noscript noembed noframes iframe title template")
NO_END_TAG = names(
    "area base basefont bgsound br col command embed frame hr img input isindex keygen link meta param source track wbr"
)
RAW_TEXT = names("script style xmp iframe noembed noframes noscript plaintext")
#: Attributes whose value is a URL; the foreign one is in its space form.
URL_ATTRIBUTES = frozenset(
    ("href", "src", "action", "formaction", "background", "cite", "longdesc", "poster", "data", "srcdoc", "manifest", "xlink href")
)
UNSAFE_PROPERTIES = names("behavior -moz-binding -ms-behavior")
#: Presets: tags, and attributes by tag.
BASIC_TAGS = "p br b i em strong a ul ol li blockquote code pre"
BASIC_ATTRIBUTES = {"a": "href title"}
UGC_TAGS = (
    "p br hr b i em strong small s del ins sub sup mark span div a ul ol li blockquote code pre kbd samp h1 h2 h3 h4 h5 h6 img figure"
    " figcaption table thead tbody tfoot tr th td caption colgroup col dl dt dd abbr cite q time"
)
UGC_ATTRIBUTES = {
    "*": "class id title dir lang",
    "a": "href name target rel",
    "img": "src alt width height loading",
    "td": "colspan rowspan",
    "th": "colspan rowspan scope",
    "col": "span",
    "colgroup": "span",
    "ol": "start reversed type",
    "time": "datetime",
    "abbr": "title",
}
MARKDOWN_TAGS = (
    "p br hr h1 h2 h3 h4 h5 h6 strong em del s a img ul ol li input blockquote code pre kbd table thead tbody tr th td span sup sub"
    " details summary abbr"
)
MARKDOWN_ATTRIBUTES = {
    "a": "href title id rel",
    "img": "src alt title width height",
    "code": "class",
    "pre": "class",
    "span": "class",
    "input": "type checked disabled",
    "th": "align colspan rowspan",
    "td": "align colspan rowspan",
    "ol": "start",
    "li": "id",
    "sup": "id",
}

# --- Fixed values: the lenient parser ---

LENIENT_VOID = names(
    "area base basefont br col command embed frame hr img input isindex keygen link meta param source track wbr"
)
LENIENT_RAW = names("script style title textarea xmp")
#: Tags that close others when they open.
LENIENT_CLOSES = {
    "tr": "tr th td",
    "th": "th",
    "td": "thead th td",
    "body": "head link script",
    "li": "li",
    "p": "p",
    "h1": "p",
    "h2": "p",
    "h3": "p",
    "h4": "p",
    "h5": "p",
    "h6": "p",
    "select": "input option optgroup select button datalist textarea",
    "input": "input option optgroup select button datalist textarea",
    "output": "input option optgroup select button datalist textarea",
    "button": "input option optgroup select button datalist textarea",
    "datalist": "input option optgroup select button datalist textarea",
    "textarea": "input option optgroup select button datalist textarea",
    "option": "option",
    "optgroup": "optgroup option",
    "dd": "dd dt",
    "dt": "dd dt",
    "address": "p",
    "article": "p",
    "aside": "p",
    "blockquote": "p",
    "details": "p",
    "div": "p",
    "dl": "p",
    "fieldset": "p",
    "figcaption": "p",
    "figure": "p",
    "footer": "p",
    "form": "p",
    "header": "p",
    "hr": "p",
    "main": "p",
    "nav": "p",
    "ol": "p",
    "pre": "p",
    "section": "p",
    "table": "p",
    "ul": "p",
    "rt": "rt rp",
    "rp": "rt rp",
    "tbody": "thead tbody",
    "tfoot": "thead tbody",
}
#: Names an object of a script engine has from the start; attributes so named are lost.
INHERITED = names(
    "constructor hasOwnProperty isPrototypeOf propertyIsEnumerable toLocaleString toString valueOf __defineGetter__ __defineSetter__"
    " __lookupGetter__ __lookupSetter__ __proto__"
)

# --- Fixed values: defaults of the lenient dialect ---

ALLOWED_TAGS = (
    "address article aside footer header h1 h2 h3 h4 h5 h6 hgroup main nav section blockquote dd div dl dt figcaption figure hr li"
    " menu ol p pre ul a abbr b bdi bdo br cite code data dfn em i kbd mark q rb rp rt rtc ruby s samp small span strong sub sup time"
    " u var wbr caption col colgroup table tbody td tfoot th thead tr"
)
ALLOWED_ATTRIBUTES = {"a": "href name target", "img": "src srcset alt title width height loading"}
NON_BOOLEAN_ATTRIBUTES = (
    "abbr accept accept-charset accesskey action allow alt as autocapitalize autocomplete blocking charset cite class color cols"
    " colspan content contenteditable coords crossorigin data datetime decoding dir dirname download draggable enctype enterkeyhint"
    " fetchpriority for form formaction formenctype formmethod formtarget headers height hidden high href hreflang http-equiv id"
    " imagesizes imagesrcset inputmode integrity is itemid itemprop itemref itemtype kind label lang list loading low max maxlength"
    " media method min minlength name nonce optimum pattern ping placeholder popover popovertarget popovertargetaction poster preload"
    " referrerpolicy rel rows rowspan sandbox scope shape size sizes slot span spellcheck src srcdoc srclang srcset start step style"
    " tabindex target title translate type usemap value width wrap onauxclick onafterprint onbeforematch onbeforeprint"
    " onbeforeunload onbeforetoggle onblur oncancel oncanplay oncanplaythrough onchange onclick onclose oncontextlost oncontextmenu"
    " oncontextrestored oncopy oncuechange oncut ondblclick ondrag ondragend ondragenter ondragleave ondragover ondragstart ondrop"
    " ondurationchange onemptied onended onerror onfocus onformdata onhashchange oninput oninvalid onkeydown onkeypress onkeyup"
    " onlanguagechange onload onloadeddata onloadedmetadata onloadstart onmessage onmessageerror onmousedown onmouseenter"
    " onmouseleave onmousemove onmouseout onmouseover onmouseup onoffline ononline onpagehide onpageshow onpaste onpause onplay"
    " onplaying onpopstate onprogress onratechange onreset onresize onrejectionhandled onscroll onscrollend"
    " onsecuritypolicyviolation onseeked onseeking onselect onslotchange onstalled onstorage onsubmit onsuspend ontimeupdate ontoggle"
    " onunhandledrejection onunload onvolumechange onwaiting onwheel"
)
ALLOWED_EMPTY_ATTRIBUTES = ("alt",)
SELF_CLOSING = "img br hr area base basefont input link meta"
ALLOWED_SCHEMES = ("http", "https", "ftp", "mailto", "tel")
SCHEME_ATTRIBUTES = (
    "href src cite action formaction data xlink:href poster background ping longdesc usemap codebase classid archive profile manifest"
    " itemid dynsrc lowsrc"
)
NON_TEXT_TAGS = ("script", "style", "textarea", "option", "xmp")
MEDIA = names("img audio video picture svg object map iframe embed")
