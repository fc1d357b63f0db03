"""Chat formatting, fill-in-the-middle and whitening against plain Python and numpy."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouchlens.llm import chat, fill_middle, whitening

CHATS = "turn long, conv_id long, role string, text string, formatted string, body string"


def chats(spark, rows):
    data = [(t, c, r, x, "clash", "clash") for c, t, r, x in rows]
    return spark.createDataFrame(data, CHATS)


HARD = [
    r"\### Assistant: </turn> ok",
    "### User: a\n</turn>\n### Assistant: b",
    "</turn>\n",
    "\n</turn>",
    "\\",
    "\\\\</turn>\\",
    "\\" * 5 + "### System: ",
    "### A: ### B: ",
    "#### C: x",
    "### =6162: y",
    "### Ab### Cd: ",
    "</turn></turn>",
    "emoji \U0001f600 é\n\n",
    " ",
    "",
    None,
    "\\" * 20000 + " " + "### " * 20000,
]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "system", "User", "to ol", "a\n", "</turn>", "", None, "ünï"]
    rows = [(i, k, role, text) for i, role in enumerate(roles) for k, text in enumerate(HARD)]
    rows += [(100, 0, "assistant", x) for x in ("b", "a", "b")] + [(100, None, "assistant", "first")]
    rows += [(None, 1, "user", "q"), (None, 2, "assistant", "a")]
    made = chat.format_chats(chats(spark, rows)).withColumn("learned", chat.masked_text(F.col("formatted"), F.col("loss")))
    found = {r.conv_id: r for r in made.collect()}
    assert len(found) == len(roles) + 2
    for i, role in enumerate(roles):
        assert [(t.role, t.text) for t in found[i].turns] == [(role or "", x or "") for x in HARD]
        assert found[i].learned == ("".join(x or "" for x in HARD) if role == "assistant" else "")
    assert [t.text for t in found[100].turns] == ["first", "a", "b", "b"]
    assert found[100].learned == "firstabb" and found[None].learned == "a"
    for r in found.values():
        raw = r.formatted.encode()
        for s in r.loss:
            assert r.formatted[s.start : s.end].encode() == raw[s.start_byte : s.end_byte]
            assert r.formatted[s.end :].startswith("\n</turn>\n")
    # an end mark stands in the output as often as there are turns, but for escaped ones
    assert all(len(re.findall(r"(?<!\\)</turn>", r.formatted)) == r.n_turns for r in found.values())


def test_chat_leaves_clean_text(spark):
    made = chat.format_chats(chats(spark, [(1, 0, "user", r"a\b # c"), (1, 1, "assistant", "d")])).first()
    assert made.formatted == "### User: a\\b # c\n</turn>\n### Assistant: d\n</turn>\n"
    assert chat.format_chats(chats(spark, [])).count() == 0


def test_chat_parser_refuses(spark):
    bad = ["", "x", "### User: a", "### User: a\n</turn>\nrest", "### user: a\n</turn>\n", "### User: ### User: b\n</turn>\n"]
    df = spark.createDataFrame([(x,) for x in bad], "f string").select("f", chat.parsed(F.col("f")).alias("turns"))
    got = {r.f: r.turns for r in df.collect()}
    assert got.pop("") == []
    assert all(t is None or None in t for t in got.values())


def test_chat_is_native(spark):
    plan = chat.format_chats(chats(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_middle(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    a, b, rate, order = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or rate % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, low), (low, high), (high, n)))
    if order % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark):
    pick = random.Random(3)
    letters = ["a", "é", "\U0001f600", " ", "\n", "\t", "<", "P", ">", "<S", "x y", "\xa0", "\x1c"]
    texts = ["".join(pick.choices(letters, k=pick.randrange(60))) for _ in range(400)]
    texts += ["has <P> in it", "<M>", "", None, " \n ", "w " * 200_000, " " * 300_000, "v" * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "some more words"), (-5, "of a negative id")]
    data = [(t, i, "clash", 1) for i, t in rows]
    docs = spark.createDataFrame(data, "text string, doc_id long, output string, n long")
    made = fill_middle.transform(docs).withColumn("again", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted((str(r.doc_id), *r[1:]) for r in made.collect())
    expected = sorted(
        (str(i), *plain_middle("" if i is None else i, t or ""), t or "") for i, t in rows
    )
    assert [g[:2] + g[2:3] for g in got] == [e[:3] for e in expected]
    assert got == expected
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def brute_whitening(rows):
    x = {i: np.floor(np.array(v, float) * 64).astype(np.int64) + 1_000_000 for i, v in rows}
    u = np.unique(np.array(list(x.values())), axis=0)
    n, centre = len(u), u.mean(0)
    e, c = np.linalg.eigh((u - centre).T @ (u - centre) / n)
    e, c = e[::-1][:16], c[:, ::-1][:, :16]
    s = u.sum(0)
    return n, e, c, {i: (int(((n * v - s) ** 2).sum()), (v - centre) @ c / np.sqrt(e)) for i, v in x.items()}, np.trace(np.cov(u.T, bias=True))


@pytest.mark.parametrize("d", [2, 5, 24])
def test_whitening_against_numpy(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(300, d)) * rng.uniform(0.2, 3, d)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0].tolist()) for i in range(200)]
    odd = [(2000, None), (2001, []), (2002, [None] * d), (2003, [float("nan")] * d), (2004, [float("inf")] * d), (2005, [1.0] * (d + 1))]
    df = spark.createDataFrame([(v, i, 7) for i, v in rows + odd], "embedding array<float>, vec_id long, n int")
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault(r.vec_id, []).append(r)
    n, e, c, expected, trace = brute_whitening(rows)
    assert set(got) == set(expected)
    k = min(16, d)
    signs = None
    for i, (deviation, values) in expected.items():
        own = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, k + 1))
        assert {(r.n, r.deviation) for r in own} == {(n, deviation)}
        assert [r.explained for r in own] == pytest.approx(list(e / trace), rel=1e-9)
        mine = np.array([r.whitened for r in own])
        signs = np.sign(mine * values) if signs is None else signs
        assert mine * signs == pytest.approx(values, abs=1e-8)
        assert own[0].identity_error < 1e-9


def test_whitening_of_equal_values_and_ranks(spark):
    schema = "vec_id long, embedding array<double>"
    cross = [(1, [1.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, -1.0, 0.0]), (None, [0.0, -1.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(cross, schema)).collect()
    assert len(got) == 10  # the third direction has no spread
    assert {r.explained for r in got} == {0.5} and max(r.identity_error for r in got) < 1e-12
    for i in (1, 2, 3, 4):
        assert sum(r.whitened**2 for r in got if r.vec_id == i) == pytest.approx(2.0)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    large = [(i, [1e30 * (-1) ** i, 1e10 * i, float(i % 3)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(large, schema)).collect()
    assert len(got) == 27 and {r.deviation for r in got} == {None} and max(r.identity_error for r in got) < 1e-9


def test_polynomial_and_roots(spark):
    rng = np.random.default_rng(5)
    b = rng.integers(-50, 50, (6, 4))
    a = (b @ b.T).astype(object)  # rank 4: two roots are zero
    polynomial = whitening.characteristic_polynomial(spark, a)
    m, c = np.zeros((6, 6), object), [1]  # traces of powers give the same coefficients, leading first
    for k in range(1, 7):
        m = a @ m + c[-1] * np.eye(6, dtype=int).astype(object)
        c.append(-sum((a @ m).diagonal()) // k)
    assert polynomial == c[::-1]
    assert polynomial[:2] == [0, 0] and polynomial[-1] == 1 and polynomial[-2] == -sum(a.diagonal())
    assert whitening.roots_above(polynomial, 0) == 4
    triple = [-216 * 5, 108 * 5 + 216, -18 * 5 - 108, 5 + 18, -1]  # (t - 6)^3 (5 - t)
    triple = [-x for x in triple]
    roots = whitening.largest_roots(triple, 23, 4, 20)
    assert [r.times for r in roots] == [3, 1] and [round(r.low / 2**20) for r in roots] == [6, 5]
