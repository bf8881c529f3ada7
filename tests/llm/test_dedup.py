"""Exact dedup, line dedup, SimHash and repeated bytes against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.llm import exact_dedup, line_dedup, repeats, simhash
from markloom.llm.common import cut
from markloom.llm.components import components

DOCS = "doc_id long, text string, source string, kept int, norm string"


def docs_of(spark, rows):
    """Extra columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, s, 7, "x") for i, t, s in rows], DOCS)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "de", "eine", "ñandú", "x1", "The"]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.25 and rows and rows[-1][1]:
            text = rows[-1][1].upper() if rng.random() < 0.5 else rows[-1][1] + " tail"
        elif kind < 0.3:
            text = rng.choice([None, "", " ", "one", "one two"])
        else:
            text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 4)))
        rows.append((i * 3 % 1000, text, rng.choice(["a", "b", "c", None])))
    rows.append((5_000, "long " * 60_000, "a"))
    return rows


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_match_brute_force(spark):
    rows = corpus()
    by = {}
    for i, t, _ in rows:
        by.setdefault(lower(t), []).append(i)
    got = exact_dedup.exact_groups(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: lower(t) for i, t, _ in rows}
    for r in got:
        group = by[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), r["doc_id"] == max(group))
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_exact_repeated_rows_and_null_ids(spark):
    rows = [(1, "A", "s"), (1, "a", "s"), (None, "a", "s"), (None, None, None), (None, None, None)]
    got = exact_dedup.exact_groups(docs_of(spark, rows)).collect()
    assert sorted((r["group_size"], r["kept"]) for r in got) == [(2, False), (2, True), (3, False), (3, False), (3, True)]
    kept = exact_dedup.drop_copies(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "kept", "norm"] and kept.count() == 2


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(4000).selectExpr("xxhash64(id) key", "100L n_bytes", "1L n_rows").union(spark.sql("select -1L, 90000L, 1L"))
    made = exact_dedup.buckets(cut(keys, "test-keys"), capacity_bytes=20_000).collect()
    held = {}
    for r in made:
        assert r["bucket"] == ((r["key"] % (1 << 64)) >> (64 - r["depth"]) if r["depth"] else 0)
        held.setdefault((r["bucket"], r["depth"]), []).append(r["n_bytes"])
    assert len(made) == 4001 and len({r["depth"] for r in made}) > 1  # what is crowded lies deeper
    assert all(sum(n) <= 20_000 or len(n) == 1 for n in held.values()) and len(held) >= 20


def test_index_lies_with_the_owners_of_buckets(spark):
    rows = [(i, f"Text number {i % 70} " * 20, "s") for i in range(100)]
    base = docs_of(spark, rows).select(F.col("doc_id").alias("id"), "text")
    norm = base.withColumn("norm", F.lower("text"))
    facts = norm.selectExpr("id", "xxhash64(norm) key", "sha2(norm, 256) sha", "cast(length(norm) as bigint) n_bytes", "xxhash64(text) digest")
    index = exact_dedup.exact_index(cut(facts, "test-facts"), base.withColumn("digest", F.xxhash64("text")), capacity_bytes=2_000)
    got = index.withColumn("file", F.input_file_name()).collect()
    other = exact_dedup.exact_index(cut(facts, "test-facts"), base.withColumn("digest", F.xxhash64("text")), 2_000, broadcast_keys=0)
    assert sorted((r["key"], r["group_size"], r["keeper"]) for r in other.collect()) == sorted((r["key"], r["group_size"], r["keeper"]) for r in got)
    assert len(got) == 70 and sum(r["group_size"] for r in got) == 100 and {r["link"] for r in got} == {0}
    assert len({r["bucket"] for r in got}) > 8
    assert all(len({r["file"] for r in got if r["bucket"] == b}) == 1 for b in {r["bucket"] for r in got})
    collided = facts.withColumn("key", F.lit(5).cast("long"))  # all keys collide: one bucket, one chain
    chained = exact_dedup.buckets(cut(collided.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")), "t"), 10)
    assert chained.count() == 1


def test_user_columns_survive_exact_dedup(spark):
    df = spark.createDataFrame([(1, "a", "x", 7), (2, "A", "y", 8)], "doc_id long, text string, _sha string, keep_id int")
    assert [tuple(r) for r in exact_dedup.drop_copies(df).collect()] == [(2, "A", "y", 8)]


@pytest.mark.parametrize("bound", [500_000, 0])
def test_lines_by_broadcast_and_by_join(spark, bound):
    shared = "this line is on every site of all"
    rows = [(i, f"own text number {i} of this one\n {shared}\t\nshort", f"s{i % 6}") for i in range(12)]
    rows += [(50, f"{shared}\n{shared}", None), (51, None, "a"), (52, "", "a"), (53, "four sites see only this line", "s1")]
    rows += [(60 + k, "four sites see only this line", f"s{k}") for k in range(4)]
    out = {r["doc_id"]: r for r in line_dedup.drop_lines(docs_of(spark, rows), broadcast_lines=bound).collect()}
    assert len(out) == len(rows)
    assert out[3]["text"] == "own text number 3 of this one" and (out[3]["n_lines"], out[3]["n_removed"]) == (3, 2)
    assert (out[50]["text"], out[50]["n_removed"]) == ("", 2)
    assert (out[51]["text"], out[51]["n_lines"]) == (None, 0) and (out[52]["text"], out[52]["n_lines"]) == ("", 1)
    assert out[53]["n_removed"] == 0 and out[3]["norm"] == "x"
    raised = line_dedup.drop_lines(docs_of(spark, rows), min_chars=20, broadcast_lines=bound).where("doc_id = 3").first()
    assert raised["text"] == "own text number 3 of this one\nshort" and raised["n_removed"] == 1


@pytest.mark.parametrize("bound", [500_000, 0])
def test_lines_of_long_texts_and_clashing_columns(spark, bound):
    rows = [(i, "\n".join(["Sign in", *[f"line {i} {k}" for k in range(3000)], " "]), f"s{i}") for i in range(6)]
    df = docs_of(spark, rows).selectExpr("doc_id", "text", "source", "1 as h", "2 as k", "3 as t", "4 as row", "5 as made", "6 as _c", "7 as body")
    out = line_dedup.drop_lines(df, broadcast_lines=bound)
    assert set(df.columns) < set(out.columns)
    assert {(r["n_lines"], r["n_removed"], r["h"], r["t"], r["body"]) for r in out.collect()} == {(3002, 1, 1, 3, 7)}


def simple_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def groups_of(ids, near):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_groups_match_brute_force(spark):
    rows = corpus()
    prints = {i: simple_fingerprint(t) for i, t, _ in rows}
    ids = sorted(prints)
    expect = groups_of(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    got = simhash.near_groups(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["fp"] % 2**64 == prints[r["doc_id"]] and r["component_id"] == expect[r["doc_id"]] for r in got)
    kept = simhash.drop_near_copies(docs_of(spark, rows))
    assert kept.count() == len(set(expect.values())) and kept.columns == ["doc_id", "text", "source", "kept", "norm"]


@pytest.mark.parametrize("crowd", [0, 3, 10_000])
def test_links_of_crowded_fingerprints(spark, crowd):
    rng = random.Random(5)
    center, prints = rng.getrandbits(64), set()
    while len(prints) < 150:
        x = center
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0, 1 << 63, (1 << 64) - 1}
    nodes = sorted(prints)
    df = spark.createDataFrame([(i, int(np.array(x, np.uint64).view(np.int64))) for i, x in enumerate(nodes)], "id long, fp long")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.links(df, crowd=crowd).collect()}
    assert got == {(i, j) for i in range(len(nodes)) for j in range(i + 1, len(nodes)) if (nodes[i] ^ nodes[j]).bit_count() <= 3}


def test_links_give_each_pair_once(spark):
    prints = [0, 1, 3, 1 << 40, (1 << 40) | 1, 7 << 32]
    df = spark.createDataFrame(list(enumerate(prints)), "id long, fp long")
    for crowd in (0, 100):
        got = [tuple(sorted((r["a"], r["b"]))) for r in simhash.links(df, crowd=crowd).collect()]
        expect = [(i, j) for i in range(6) for j in range(i + 1, 6) if (prints[i] ^ prints[j]).bit_count() <= 3]
        assert sorted(got) == expect


def test_null_and_repeated_ids_lose_no_link(spark, monkeypatch):
    # fingerprints are put in by hand: 0, 7 and 63 differ by three bits each
    prints = {"a": 0, "b": 7, "c": 63, "d": (1 << 62) - 1}
    monkeypatch.setattr(simhash, "fingerprint", lambda t: prints[t])
    by_hand = lambda docs, text="text", name="fp": docs.withColumn(name, F.create_map(*[F.lit(x) for kv in prints.items() for x in kv])[F.col(text)].cast("long"))
    monkeypatch.setattr(simhash, "with_fingerprint", by_hand)
    rows = [(1, "a", "s"), (None, "b", "s"), (2, "c", "s"), (2, "d", "s"), (9, "d", "s"), (9, "d", "s")]
    got = sorted(((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.near_groups(docs_of(spark, rows)).collect()))
    far = prints["d"]
    assert got == [(0, 7, 1), (1, 0, 1), (2, 63, 1), (2, far, 2), (9, far, 2), (9, far, 2)]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_never_stop_unsettled(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(chain, max_steps=1)


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - 99):
            if body[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(body[p : p + 100])
        kept = bytes(x for x, g in zip(body, gone, strict=True) if not g)
        runs = len([r for r in bytes(gone).split(b"\0") if r])
        out[i] = (len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes_match_brute_force(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = [(i * 2, "".join(rng.choice(pool)[rng.randint(0, 40) :] if rng.random() < 0.6 else str(rng.random()) for _ in range(rng.randint(0, 5))), "s") for i in range(60)]
    rows += [(500, "ab" * 300, "s"), (501, "z" * 1000, "s"), (502, None, "s"), (503, "y" * 99, "s"), (504, "y" * 100, "s"), (505, "y" * 101, "s")]
    got = {r["doc_id"]: r for r in repeats.cut_repeats(docs_of(spark, rows)).collect()}
    for i, expect in brute_repeats([(i, t) for i, t, _ in rows]).items():
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expect
        assert hashlib.sha256(r["kept"]).hexdigest() == expect[3]


def test_repeated_rows_are_one_text(spark):
    rows = [(1, "k" * 50 + "m" * 80, "s"), (1, "k" * 50 + "m" * 80, "s"), (2, "k" * 50 + "m" * 80, "s")]
    got = sorted((r["doc_id"], r["n_removed"]) for r in repeats.cut_repeats(docs_of(spark, rows)).collect())
    assert got == [(1, 0), (1, 0), (2, 130)]


def test_rows_with_one_id_or_none_are_texts_of_their_own(spark):
    rng = random.Random(8)
    passage, other = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (200, 300))
    rows = [(1, passage, "s"), (2, passage, "s"), (2, other, "s")]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.cut_repeats(docs_of(spark, rows)).collect())
    assert got == [(1, 200, 0), (2, 200, 200), (2, 300, 0)]
    rows = [(None, passage + "x", "s"), (None, passage + "y", "s"), (5, passage, "s"), (6, "é" * 70_000 + passage, "s")]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.cut_repeats(docs_of(spark, rows)).collect())
    expect = brute_repeats([(0, passage + "x"), (5, passage), (6, "é" * 70_000 + passage)])
    assert got == [(0, 0), (0, 200), (5, 200), (6, expect[6][1])]


def test_anchors_are_alike_in_long_texts_cut_to_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "MOST", 1 << 12)
    rng = random.Random(2)
    body = "".join(rng.choice("abcd") for _ in range(9_000)).encode()
    total = sum(int(repeats.anchors(data, starts)[2].sum()) for _, _, data, starts in repeats._groups([body]))
    assert total == len(body) - 99


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert line_dedup.drop_lines(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert repeats.cut_repeats(empty).count() == 0


def test_suffix_array_and_repeats(spark, monkeypatch):
    from markloom.llm import suffix_array

    monkeypatch.setattr(suffix_array, "SMALL", 90)  # one level of recursion
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for i in range(4)} | {20: "ab" * 20, 21: "é" * 4, 22: "ab" * 20}
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    got = [(r["doc"], r["start"]) for r in suffix_array.suffix_array(docs).orderBy("rank").collect()]
    order = sorted(texts)
    expect = sorted(((texts[d].encode()[s:], order.index(d)), (d, s)) for d in texts for s in range(len(texts[d].encode())))
    assert got == [x for _, x in expect]
    seen, repeated = set(), set()
    for d in order:
        body = texts[d].encode()
        for s in range(len(body) - 9):
            if body[s : s + 10] in seen:
                repeated.add((d, s))
            seen.add(body[s : s + 10])
    assert {tuple(r) for r in suffix_array.repeated_starts(docs, 10).collect()} == repeated
