"""Whitening, id shards and tokenizer alignment against brute-force versions, with odd rows, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import align, shards, whitening
from riskloom.llm.ids import LibraryIds
from riskloom.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
LONG = "lorem ipsum dolor " * 20_000
ODD = ["", None, " ", "a", "a  b", "\n\n x", "x \n", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "it's we'll '  s", "日本語 テスト 𝔘", "a\x85b \x1c c", "tab\t\tx  ", "１２ ½ ²", "aaaa" * 500, "a\r\n\r\nb", "é ́", "\x00z", "Naïve, café; naïve!", "x.\nErnt", "<s> </s> <unk> ▁ <0x41>"]


def documents(spark, texts, ids=None):
    """A documents table with extra columns that clash with the operators' own names."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", 7, "x", 1, 2, 3) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, shard string, nth int, row int, link_row int")


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


# --- ids -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("special", [True, False])
def test_ids_are_the_librarys(corpus, special):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = not special
    ours = LibraryIds(A, special, limit=500)  # tables begin anew many times
    for text in [*(t or "" for t in ODD), LONG, *corpus]:
        assert ours.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert LibraryIds(A).size == 50_257


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 'sé\n\t.,! 　９x"), max_size=40))
def test_ids_of_small_texts(text):
    from tokenizers import Tokenizer

    held = test_ids_of_small_texts.__dict__.setdefault("held", (Tokenizer.from_file(A), LibraryIds(A)))
    assert held[1].encode(text).tolist() == held[0].encode(text, add_special_tokens=False).ids


# --- shards --------------------------------------------------------------------------------------------


def brute_shards(rows):
    from tokenizers import Tokenizer

    library, at, out = Tokenizer.from_file(A), 0, []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_shards_give_back_every_document(spark, corpus):
    texts = [*ODD, LONG, *corpus]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    got = [tuple(r) for r in shards.round_trip(documents(spark, texts, ids), A).collect()]
    assert sorted(got) == brute_shards(sorted(zip(ids, texts, strict=True), key=lambda r: r[0]))
    assert shards.round_trip(documents(spark, []), A).collect() == []


def test_repeated_and_null_keys_are_counted_over_shards(spark):
    keys = [5] * 300 + [None] * 40 + [7, 9, -3]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = shards.write(documents(spark, [f"text {i}" for i in range(len(keys))], keys).repartition(8), A)
        rows = made.keys.orderBy("shard", "offset").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["shard"] for r in rows}) > 1
    want: Counter = Counter()
    for r in rows:
        assert r["nth"] == want[r["doc_id"]]
        want[r["doc_id"]] += 1
    assert want == Counter(keys)
    assert [r["doc_id"] for r in rows] == sorted(keys, key=lambda k: (k is not None, k or 0))
    got = shards.round_trip(documents(spark, ["same"] * len(keys), keys), A).collect()
    n = got[0]["n_tokens"]
    assert sorted(r["start"] for r in got) == [n * i for i in range(len(keys))]


def test_access_by_key(spark):
    texts = ["alpha beta", "", None, LONG, "gamma"]
    made = shards.write(documents(spark, texts, [10, 20, None, 30, 10]), A, part_keys=2)
    assert made.layout.parts == 3 and made.layout.width == 2
    reader, library = shards.Reader(made.layout), LibraryIds(A)
    for key, nth, text in [(10, 0, "alpha beta"), (10, 1, "gamma"), (20, 0, ""), (None, 0, ""), (30, 0, LONG)]:
        assert reader.ids(key, nth).tolist() == [*library.encode(text).tolist(), 2]
    assert reader.ids(11) is None and reader.ids(10, 2) is None and reader.ids(None, 1) is None
    asked = spark.createDataFrame([(10, 1), (11, 0), (20, 0), (20, 0)], "doc_id long, nth long")
    got = shards.read(made, shards.locate(made, asked)).collect()
    assert sorted((r["doc_id"], r["nth"], len(r["ids"])) for r in got) == [(10, 1, len(library.encode("gamma")) + 1), (20, 0, 1), (20, 0, 1)]


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), ("ä", "three")], "doc_id string, text string")
    made = shards.write(docs, A)
    assert [r["doc_id"] for r in made.keys.orderBy("shard", "offset").collect()] == ["a", "b", "ä"]
    reader, library = shards.Reader(made.layout), LibraryIds(A)
    assert all(reader.ids(k).tolist() == [*library.encode(t).tolist(), 2] for k, t in [("a", "one"), ("b", "two"), ("ä", "three")])


def test_hashes_outside_spark_are_sparks(spark):
    keys = [(0, 0), (-5, 3), (2**62, 1), (None, 2)]
    df = spark.createDataFrame(keys, "doc_id long, nth long").select(*[F.lit(1)], *shards.hashes("doc_id", "nth"))
    for row, key in zip(df.collect(), keys, strict=True):
        assert tuple(x & (2**64 - 1) for x in row[1:]) == shards.key_hashes(*key)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    hashed, prints = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 2**63, n).astype(np.uint64)
    if n == 1000:
        hashed[:300] = hashed[0]  # hashes that can't be told apart: the fingerprint does
    entries = np.zeros(n, shards.ENTRY)
    entries["print"], entries["offset"], entries["shard"], entries["n"] = prints, np.arange(n), 3, 7
    part = shards.Part.read(shards.Part.build(hashed, entries).data())
    assert sorted(part.hashed.slots(hashed, prints).tolist()) == list(range(n))
    found, got = part.find(hashed, prints)
    assert found.all() and (got["offset"] == np.arange(n)).all()
    other = rng.integers(0, 2**63, 1000).astype(np.uint64)
    assert not part.find(other, other)[0].any()
    if n == 40_000:
        assert len(part.hashed.words) * 64 < 6 * n and not len(part.hashed.rest)
    with pytest.raises(ValueError):
        shards.Part.read(b"no such part of an index")


# --- alignment -----------------------------------------------------------------------------------------


def brute_alignment(texts):
    """Groups by common byte offsets, links by overlap of byte ranges, counts over all texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    sides = align.Sides(A, B)
    rows, held = [], Counter()
    for text in texts:
        a, b = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        data = (" " + (text or "")).encode()
        if not text or b"".join(sides.left[x] for x in a) != data or b"".join(sides.right[x] for x in b) != data:
            rows.append(([], [], [], ""))
            continue
        spans = []
        for ids, table in ((a, sides.left), (b, sides.right)):
            ends = np.cumsum([len(table[x]) for x in ids])
            spans.append([(x, e - len(table[x]), e) for x, e in zip(ids, ends.tolist(), strict=True)])
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        members = [defaultdict(list), defaultdict(list)]
        for side in (0, 1):
            k = 0
            for x, _, e in spans[side]:
                while cuts[k] < e:
                    k += 1
                members[side][k].append(str(x))
        links, j = [], 0
        for x, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((x, spans[1][k][0]))
                k += 1
        held.update(set(links))
        shown = ";".join(f"{','.join(members[0][k])}|{','.join(members[1][k])}" for k in range(len(cuts)))
        rows.append((a, b, links, shown))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for a, b, links, shown in rows:
        out.append((len(a), len(b), shown.count("|"), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


@pytest.mark.parametrize("table_pairs", [10**6, 0])
def test_alignment_equals_brute_force(spark, corpus, table_pairs):
    texts = [*ODD, LONG[:50_000], *corpus[:120], *ODD]
    ids = [None, *range(1, len(texts) - 1), 1]
    got = align.align_documents(documents(spark, texts, ids), A, B, table_pairs).collect()
    want = Counter((i, *r) for i, r in zip(ids, brute_alignment(texts), strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert sum(r["n_groups"] == 0 for r in got) >= 4  # null, empty, and what a side doesn't spell
    assert align.align_documents(documents(spark, []), A, B, table_pairs).collect() == []


def test_groups_cover_the_bytes(spark):
    text = "Naïve café — 日本語 transformational"
    rows = align.groups(documents(spark, [text, None, ""]), A, B).orderBy("group").collect()
    assert rows[0]["start"] == 0 and rows[-1]["end"] == len((" " + text).encode())
    assert all(a["end"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert ["|".join(",".join(map(str, r[c])) for c in ("a_ids", "b_ids")) for r in rows] == align.Sides(A, B).transducer.align(*align.Sides(A, B).encode([text])[0])[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.data())
def test_transducer_on_random_cuts(lengths, data):
    """Any two ways to cut one string: groups end at common cuts, links are overlaps."""
    total = sum(lengths)
    text = bytes(data.draw(st.lists(st.sampled_from([97, 98]), min_size=total, max_size=total)))
    cuts = sorted({total, *data.draw(st.lists(st.integers(1, total), max_size=20))})
    ends = np.cumsum(lengths).tolist()
    tokens: list[bytes] = sorted({text[max(0, i) : j] for side in (ends, cuts) for i, j in zip([0, *side[:-1]], side, strict=True)})
    ids = [[tokens.index(text[i:j]) for i, j in zip([0, *side[:-1]], side, strict=True)] for side in (ends, cuts)]
    groups, links = align.Transducer(tokens, tokens, limit=10).align(*ids)
    common = sorted(set(ends) & set(cuts))
    assert len(groups) == len(common) and len(links) == len(ends) + len(cuts) - len(common)
    spans = [list(zip([0, *side[:-1]], side, strict=True)) for side in (ends, cuts)]
    overlaps = Counter(i * align._WIDE + j for i, (s, e) in zip(ids[0], spans[0], strict=True) for j, (s2, e2) in zip(ids[1], spans[1], strict=True) if s < e2 and s2 < e)
    assert Counter(links) == overlaps


def test_transducer_refuses_other_bytes():
    with pytest.raises(ValueError):
        align.Transducer([b"ab"], [b"ac"]).align([0], [0])


# --- whitening -----------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n long, component int")


def brute_whitening(rows, components=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    width = max(len(v) for _, v in kept)
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in kept]
    fit = [list(t) for t in {tuple(r) for r in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums, strict=True)] for r in fit])
    cov = centred.T @ centred / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    at = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums, strict=True)] for r in x]) @ w
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in kept], n, deviation, at / np.sqrt(e), e / np.trace(cov)


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(400, 20)) @ np.diag(np.linspace(0.2, 3, 20))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a third of the rows are one vector
    rows += [(None, rows[5][1]), (7, rows[9][1]), (2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf"), *[0.0] * 19]), (2004, [1.0] * 7), (2005, [])]
    got = whitening.whiten(vectors(spark, rows).repartition(7)).collect()
    ids, n, deviation, white, explained = brute_whitening(rows)
    assert len(got) == 16 * len(ids) and {r["n"] for r in got} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter(zip(ids, deviation, strict=True))
    assert {r["identity_error"] for r in got}.pop() < 1e-12 and len({r["identity_error"] for r in got}) == 1
    table = defaultdict(dict)
    for r in got:
        table[r["vec_id"], r["deviation"]][r["component"]] = r
    for k in range(16):
        ours = np.array([table[i, d][k + 1]["whitened"] for i, d in zip(ids, deviation, strict=True)])
        sign = np.sign(ours @ white[:, k])
        assert np.abs(ours * sign - white[:, k]).max() < 1e-9
        assert abs(table[ids[0], deviation[0]][k + 1]["explained"] / explained[k] - 1) < 1e-9


def test_whitening_of_flat_and_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).collect() == []
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()  # one distinct vector: no variance
    assert len(got) == 4 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["explained"] == 0 for r in got)
    got = whitening.whiten(vectors(spark, [(i, [float(i), 5.0, 2.0 * i]) for i in range(9)])).collect()  # one direction only
    assert len(got) == 27 and {r["component"] for r in got if r["whitened"] is not None} == {1} and got[0]["identity_error"] < 1e-9
    got = whitening.whiten(vectors(spark, [(1, [1e38, 0.0]), (2, [-1e38, 1.0]), (3, [0.0, -1.0])])).collect()
    assert len(got) == 6 and all(r["deviation"] > 0 for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=6), st.integers(0, 10**6))
def test_moments_merge_to_those_of_all_rows(sizes, seed):
    rng = np.random.default_rng(seed)
    blocks = [np.floor(rng.normal(size=(n, 3)) * 50) + 1_000_000 for n in sizes]
    rows = np.concatenate(blocks)
    if not len(rows):
        return
    got = whitening.Moments(0, np.zeros(3), np.zeros((3, 3)), [0] * 3)
    for b in blocks:
        got = got.merged(whitening.Moments.of(b) if len(b) else whitening.Moments(0, np.zeros(3), np.zeros((3, 3)), [0] * 3))
    off = rows - rows.mean(0)
    assert got.n == len(rows) and got.sums == [int(s) for s in rows.sum(0)]
    assert np.allclose(got.scatter, off.T @ off, atol=1e-6) and np.allclose(got.mean, rows.mean(0))


def test_sums_beyond_a_long_are_exact():
    rows = np.full((5000, 2), 2.0**52)
    assert whitening.exact_sums(rows) == [5000 * 2**52] * 2
    made = whitening.Whitening(5000, [5000 * 2**52, 0], np.ones(2), np.eye(2), 2.0)
    assert made.deviations(np.array([[0.0, 0.0]]))[1][0] == 2**63 - 1
