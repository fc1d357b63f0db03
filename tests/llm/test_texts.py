"""Operators on texts against brute force, with nulls, empty and long texts, repeats, clashes and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vouchlens.llm import bpe, components, decontaminate, jaccard, pii, ppm, suffix_dedup, token_counts, toxicity
from vouchlens.llm.common import remainder

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, n long, words string, block int, prefix string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def made_texts():
    """Near and exact copies, shared passages, a long text, empty ones, odd white space."""
    rnd = random.Random(5)
    pool = ["the", "of", "and", *(f"w{i}" for i in range(300))]
    make = lambda n: [rnd.choice(pool) for _ in range(n)]
    passage, base = make(30), make(90)
    out = []
    for i in range(60):
        body = make(rnd.randrange(1, 80))
        if i % 4 == 0:
            body += passage
        out.append(" ".join(body))
    for _ in range(60):  # a large group of near copies
        copy = list(base)
        for _ in range(rnd.randrange(0, 4)):
            copy[rnd.randrange(len(copy))] = rnd.choice(pool)
        out.append(" ".join(copy))
    out += [out[3]] * 5 + ["", None, " \t\n", "One two", "ONE\ttwo", "É ﬁ 你好\x1cx", "a" * 3000, " ".join(make(5000))]
    return out


def frame(spark, found, ids=None):
    ids = ids or [10 * i + 3 for i in range(len(found))]
    rows = [(i, t, 1, "x", 2, "y") for i, t in zip(ids, found, strict=True)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    found = made_texts()
    ids = [10 * i + 3 for i in range(len(found))]
    return {"df": frame(spark, found).cache(), "rows": list(zip(ids, found, strict=True))}


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_as_the_library(spark, docs, nothing):
    special = [(1, "a<|endoftext|>B <|startoftext|>"), (1, "a<|endoftext|>B <|startoftext|>"), (None, "aaaa aaa")]
    rows = docs["rows"] + special
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    encoded = bpe.encode(df, PATH)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in encoded.collect()) == want
    again = {(r.doc_id, r.decoded) for r in bpe.decode(encoded, PATH).collect()}
    assert again == {(i, d) for i, _, d in want}
    counts = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, PATH).collect())
    assert counts == Counter(
        (i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows
    )
    assert bpe.encode(nothing, PATH).isEmpty() and token_counts.count_tokens(nothing, PATH).isEmpty()


def plain_pii(text):
    """The base kinds as the patterns read, with no further care."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans(spark, nothing):
    rnd = random.Random(2)
    parts = ["a.b@c.de", "@", "x@y", "é", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (20) 345-67.89", "..", " ", "-", "9" * 40, "+12", "..@a-b.c.d", "007.0.0.1", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789"]
    found = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 12))) for _ in range(400)] + [None, "", "1." * 5000, "9" * 20000, "a" * 20000 + "@"]
    for t in found:
        assert [s[:3] for s in pii.find(t or "") if s[0] in pii.BASE] == plain_pii(t or "")
    df = frame(spark, found)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(df).collect()}
    assert len(got) == len(found) and got[3] == [s[:3] for s in pii.find(found[0])]
    assert pii.redact("to a.b@c.de, 1.2.3.4") == "to <email>, <ip>"
    assert {s[0] for s in pii.find("ssn 123-45-6789 iban GB82 WEST 1234 5698 7654 32")} >= {"national", "iban"}
    masked = pii.redact_pii(df)
    assert masked.columns == df.columns and masked.where("text is null").count() == 1
    assert pii.find_pii(nothing).isEmpty() and pii.redact_pii(nothing).isEmpty()


def components_of(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        components.join(parent, a, b)
    return {n: components.find(parent, n) for n in nodes}


def plain_join(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and (n := len(sets[a] & sets[b])) and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    count = Counter(x for link in links for x in link)
    parts = components_of(sets, links)
    return {(i, len(s), parts[i], count[i]) for i, s in sets.items()}


def test_blocks_of_a_large_group_are_kept_once(spark, monkeypatch):
    """A group is compared block by block with itself, but its sets are not sent once for each block."""
    words = [f"w{i}" for i in range(60)]
    found = [" ".join([*words[: 40 + i % 3], f"own{i}"]) for i in range(60)] + ["a b c d e f g"] * 3
    df = frame(spark, found, range(len(found)))
    settings = jaccard.Settings(3, 80)
    whole = sorted(tuple(r) for r in jaccard.similarity_join(df, settings).collect())
    assert {r[3] for r in whole} == {59, 2} and {r[2] for r in whole} == {0, 60}
    sent, dealt = [], jaccard.in_tasks

    def counted(sets):
        out = dealt(sets)
        sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "in_tasks", counted)
    monkeypatch.setattr(jaccard, "CELL", 200)
    assert sorted(tuple(r) for r in jaccard.similarity_join(df, settings).collect()) == whole
    assert sum(sent) <= jaccard.DEALT * len(found)


def test_sets_packed_together():
    rng = np.random.default_rng(5)
    own = [np.unique(rng.integers(0, 50, n).astype(np.uint64) * np.uint64(1 << 57)) for n in (1, 40, 7, 200)]
    back = jaccard.unpacked_sets(*jaccard.packed_sets(own))
    assert len(back) == 4 and all((a == b).all() for a, b in zip(own, back, strict=True))


@pytest.mark.parametrize("limits", [{}, {"SHORT": 4, "CELL": 1500, "SHARED": 3, "HOT": 1 / 64}])
def test_similarity_join(docs, nothing, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    for words, percent in ((4, 85), (5, 80)):
        got = jaccard.similarity_join(docs["df"], jaccard.Settings(words, percent))
        assert {tuple(r) for r in got.collect()} == plain_join(docs["rows"], words, percent)
    assert jaccard.similarity_join(nothing).isEmpty()


@pytest.mark.parametrize("cell", [10, 40, 150])
def test_similarity_join_of_few_long_texts_in_many_blocks(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    body = [f"v{i}" for i in range(200)]
    found = [" ".join([*body, f"end{i}"]) for i in range(3)]
    got = jaccard.similarity_join(frame(spark, [*found, "a b c d e f"], [1, 2, 3, 4]))
    assert {tuple(r) for r in got.collect()} == {(1, 197, 1, 2), (2, 197, 1, 2), (3, 197, 1, 2), (4, 2, 4, 0)}


def test_similarity_join_of_repeats_and_missing_ids(spark):
    df = frame(spark, ["a b c d e f"] * 3 + ["a b c d e f", None], [5, 5, None, 4, None])
    got = Counter(tuple(r) for r in jaccard.similarity_join(df).collect())
    assert got == Counter({(5, 2, 4, 2): 2, (4, 2, 4, 2): 1, (None, 2, None, 0): 1, (None, 0, None, 0): 1})


def test_similarity_join_of_ids_with_several_texts(spark):
    rnd = random.Random(3)
    a, b, c = ([f"{x}{rnd.randrange(10**6)}" for _ in range(60)] for x in "abc")
    near = lambda words, i: " ".join([*words, f"end{i}"])
    rows = [(7, near(a, 0)), (7, near(b, 0)), (8, near(a, 1)), (9, near(b, 1)), (9, near(c, 0)), (7, near(a, 2)), (4, near(c, 1)), (4, "x y z")]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = Counter(tuple(r) for r in jaccard.similarity_join(df).collect())
    assert got == Counter({(7, 57, 7, 2): 2, (7, 57, 7, 1): 1, (8, 57, 7, 2): 1, (9, 57, 7, 1): 1, (9, 57, 4, 1): 1, (4, 57, 4, 1): 1, (4, 1, 4, 0): 1})


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    want = components_of({x for link in links for x in link}, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert {tuple(r) for r in components.components(df).collect()} == {(n, want[n]) for n in touched}
    assert components.components(df.where("a < 0")).isEmpty()


def test_ppm(docs, nothing):
    scored = {r.doc_id: r for r in ppm.score_texts(docs["df"], remainder("doc_id", 10) != 0).collect()}
    train = [t or "" for i, t in docs["rows"] if zlib.crc32(str(i).encode()) % 10]
    tokens = Counter(w for t in train for w in [*words_of(t), "\0"])
    total, kinds, depth = sum(tokens.values()), len(tokens), ppm.ORDER
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    padded = lambda t: b"\xfe" * depth + t.translate(LOWER).encode() + b"\xff"
    for t in train:
        b = padded(t)
        for p in range(depth, len(b)):
            for k in range(depth + 1):
                counts[k][b[p - k : p]][b[p]] += 1
    for i, t in docs["rows"]:
        own = [*words_of(t), "\0"]
        base = sum(math.log10((tokens[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        b, chance = padded(t or ""), 0.0
        for p in range(depth, len(b)):
            out = set()
            for k in range(depth, -1, -1):
                seen = {s: n for s, n in counts[k].get(b[p - k : p], {}).items() if s not in out}
                n = sum(seen.values())
                if b[p] in seen:
                    chance += math.log10(seen[b[p]] / (n + len(seen)))
                    break
                if seen:
                    chance += math.log10(len(seen) / (n + len(seen)))
                    out |= set(seen)
            else:
                chance -= math.log10(256 - len(out))
        r = scored[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(tokens[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(chance, rel=1e-9)
    assert ppm.score_texts(nothing, remainder("doc_id", 10) != 0).isEmpty()
    bare = ppm.score_texts(docs["df"].where("doc_id = 3"), remainder("doc_id", 1) != 0).first()
    assert bare.train_tokens == 0 and bare.score < 0


def test_tasks_hold_little_of_what_they_have_read(monkeypatch):
    """What a task remembers is bounded well under its share of an executor, and its results don't depend on the bound."""
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=7)) for _ in range(400)) for _ in range(600)]
    terms = toxicity.Terms(1 << 18)
    found = [terms.of_text(t).tolist() for t in texts]
    assert len(terms.known) < 110_000
    assert found[-3:] == [toxicity.Terms(1 << 18).of_text(t).tolist() for t in texts[-3:]]
    table = bpe.merges(public_tokenizers.path("word_bpe_49k.json"))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts[:300]})
    chunks = bpe.Chunks(table, bpe.values(table), 1 << 20)
    got, most = [], 0
    for part in bpe.slices(batch, size=64 << 10):
        got += bpe.encode_texts(table, part.column(1).to_pylist(), chunks)[0]
        most = max(most, chunks.size)
    assert most < 12 << 20
    assert got[-2:] == bpe.encode_texts(table, texts[298:300], bpe.Chunks(table, bpe.values(table)))[0]


def test_minimizers_of_many_texts_are_those_of_each(monkeypatch):
    """Texts are joined for speed; no run reaches from one text into the next."""
    monkeypatch.setattr(suffix_dedup, "JOINED", 300)
    rng = np.random.default_rng(5)
    lengths = [0, 49, 50, 0, 0, 51, 1, 120, 700, 60, 0, 200, 200, 49, 0]
    datas = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in lengths]
    datas += [datas[7], b"x" * 90, b"x" * 80, b""]
    want = []
    for t, data in enumerate(datas):
        if len(data) >= suffix_dedup.LENGTH:
            for w in range(len(data) - suffix_dedup.LENGTH + 1):
                own = suffix_dedup.window_minimizers(np.frombuffer(data[w : w + suffix_dedup.LENGTH], np.uint8))
                want.append((t, w, int(own[0])))
    text, start, end, low = suffix_dedup.minimizer_runs(datas)
    runs = list(zip(text.tolist(), start.tolist(), end.tolist(), low.tolist(), strict=True))
    assert [(t, w, v) for t, s, e, v in runs for w in range(s, e)] == want
    assert len(runs) < len(want) / 4 and all((a[0], a[3]) != (b[0], b[3]) for a, b in zip(runs, runs[1:], strict=False))
    assert all(len(x) == 0 for x in suffix_dedup.minimizer_runs([]) + suffix_dedup.minimizer_runs([b"", b"short"]))


def test_suffix_arrays():
    rnd = random.Random(3)
    for top in (1, 2, 4, 200):
        for n in (0, 1, 2, 3, 4, 5, 31, 60):
            s = np.array([rnd.randrange(1, top + 1) for _ in range(n)], np.int64)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("hot", [1000, 0])
def test_repeated_bytes(docs, nothing, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    first, want = {}, {}
    for i, t in sorted(docs["rows"]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = [True] * 50
        want[i] = (len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    found = suffix_dedup.remove_repeats(docs["df"]).collect()
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in found} == want
    assert len(found) == len(want) and any(w[1] for w in want.values())
    assert suffix_dedup.remove_repeats(nothing).isEmpty()


def test_repeated_bytes_without_ids(spark):
    text = "abcdefghij" * 8
    df = frame(spark, [text] * 4, [7, 7, None, 9])
    got = sorted(((r.doc_id or 0), len(r.kept)) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(0, 80), (7, 80), (7, 80), (9, 0)]


def plain_contamination(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = {}
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(13, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("literals", [20_000, 0])
def test_decontamination(spark, docs, nothing, literals, monkeypatch):
    monkeypatch.setattr(decontaminate, "LITERALS", literals)
    rnd = random.Random(9)
    items = []
    for k, (_, t) in enumerate(docs["rows"][:40]):
        w = (t or "").upper().split()
        at = rnd.randrange(max(1, len(w) - 20))
        items.append((k, " - ".join(w[at : at + rnd.choice([2, 3, 5, 12, 13, 14, 20])])))
    items += [(50, None), (51, ""), (52, "one TWO"), (10, items[3][1]), (10, items[3][1])]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, words string")
    got = decontaminate.contamination(docs["df"], bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got} == plain_contamination(docs["rows"], items)
    assert len(got) == len(docs["rows"])
    assert decontaminate.contamination(nothing, bench).isEmpty()
    assert not decontaminate.contamination(docs["df"], bench.limit(0)).where("n_hit > 0 or contaminated").count()


def test_toxicity(spark, nothing):
    rnd = random.Random(6)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        own, toxic = [rnd.choice(plain) for _ in range(60)], int(rnd.random() < 0.2)
        if toxic:
            own[rnd.randrange(60)] = rnd.choice(["idiotish", "idiotly", "scum"])
        rows.append((i, " ".join(own)))
        labels.append((i, toxic, "x"))
    rows += [(2000, None), (2001, ""), (2001, ""), (None, "scum")]
    labels += [(None, 1, "x"), (2000, None, "x")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.fit(toxicity.labelled_texts(docs, marks))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].predicted, y) for i, y, _ in labels[:1500] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert 0 <= got[2000].score < 0.5 and got[2000].score == got[2001].score and got[None].predicted == 1
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("text like '%scum%'").isEmpty()
    empty = toxicity.fit(toxicity.labelled_texts(nothing, marks.limit(0)))
    assert toxicity.score(nothing, empty).isEmpty() and 0 <= toxicity.score(docs, empty).first().score < 0.5


def test_signature_is_of_the_set():
    a, b = jaccard.shingle_sets(["x y z x y z x y z", "y z x y z x y z x y z"], 3)
    assert jaccard.signature(a) == jaccard.signature(b) == hashlib.blake2b(a.tobytes(), digest_size=16).digest()


def test_long_words_are_told_apart(spark):
    """Two letters in the order of the Thue-Morse sequence and its mirror have equal polynomials modulo 2^64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate({97: 98, 98: 97})
    rest = " ".join(f"w{i}" for i in range(2))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a.upper()} {rest}")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similarity_join(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
