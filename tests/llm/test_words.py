import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import periodic, spelling, token_counts
from ledgerwatch.llm.queries import QUERIES, made_periodic, misspelt
from tests.llm.plain import SCHEMA, odd_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ---- spelling -------------------------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def plain_variants(counts, factor=5):
    out = []
    for w, n in counts.items():
        near = sorted(((-m, v) for v, m in counts.items() if one_edit(w, v)))
        form = near[0][1] if near and -near[0][0] >= factor * n else None
        out.append([w, form, None, n, len(near), counts[form] if form else None])
    forms = {r[0]: r[1] for r in out}
    for r in out:
        r[2] = r[0]
        while forms[r[2]]:
            r[2] = forms[r[2]]
    return sorted(map(tuple, out))


def plain_words(rows, noise):
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    counts = Counter()
    for doc, text in rows:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_near_words_match_a_comparison_of_all(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdxyzéÿ÷") for _ in range(rng.randint(1, 9))) for _ in range(15)]
    words = {s[:k] + rng.choice(["", "a", "é", "q"]) + s[k + rng.randint(0, 1):] for s in stems for k in range(len(s))} | set(stems) | {"x" * 200, "x" * 201, "x" * 200 + "q"}
    counts = {w: rng.choice([5, 6, 30, 150, 900, 5000]) for w in words if w}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == plain_variants(counts)


def test_neighbourhoods_are_not_broadcast(spark, tmp_path):
    """A vocabulary of few bytes has many forms; the plans broadcast neither them nor the words, in whatever size."""
    spark.createDataFrame([("abcdef" + "xyz"[k % 3] * (k % 40 + 1), 5 + k) for k in range(300)], "word string, n long").dropDuplicates(["word"]).write.parquet(f"{tmp_path}/words")
    vocabulary = spark.read.parquet(f"{tmp_path}/words")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    chain = vocabulary.select("word", F.lit(None).cast("string").alias("form"))
    for df in (spelling.near_words(vocabulary), spelling.roots(chain), spelling.variants(vocabulary)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_neighbourhood_is_full(spark):
    for form in ("0", "01", "7707", "0" * 5):
        want = {form} | {form[:k] + form[k + 1:] for k in range(len(form))}
        want |= {form[:k] + s + form[k + d:] for d in (0, 1) for s in spelling.SYMBOLS for k in range(len(form) + 1 - d)}
        (row,) = spark.createDataFrame([(form,)], "f string").select(spelling.neighbourhood("f").alias("n")).collect()
        assert set(row["n"]) == want and len(row["n"]) == len(want)


def test_words_of_one_reduced_form_are_compared(spark):
    # one hot key: letters that share a symbol make thousands of words with the same reduced form
    alike = [chr(c) for a, b in spelling.LETTERS for c in range(ord(a), ord(b) + 1) if c % 8 == 1 and not 65 <= c <= 90]
    rng = random.Random(2)
    words = sorted({"".join(rng.choice(alike) for _ in range(6)) for _ in range(700)})
    counts = {w: 5 + k % 40 for k, w in enumerate(words)}
    forms = spark.createDataFrame([(w,) for w in words], "w string").select(spelling.reduced("w").alias("f")).distinct()
    assert forms.count() == 1
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == plain_variants(counts)


def test_forms_are_followed_to_the_last(spark):
    chain = [("w" * 6 + "abcdefghij"[:k], 5 * 5**k) for k in range(10)]
    got = spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r["root"] for r in got} == {chain[-1][0]} and sum(r["form"] is None for r in got) == 1


def test_spelling_query_counts_like_a_plain_one(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeéÉXYZ") for _ in range(rng.randint(5, 10))) for _ in range(25)]
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, "", "×÷", " ".join(base * 6), " -".join(rng.choices(base, k=60))])) for _ in range(400)]
    rows += rows[:20]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, word string, n long")
    got = spelling.spelling_variants(docs, misspelt)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(plain_words(rows, True))
    assert len(want) > 20 and sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()) == want
    assert spelling.spelling_variants(docs.limit(0), misspelt).collect() == []


# ---- token counts ---------------------------------------------------------------------------

PARTS = [" ", "  ", "\n", "\t", "\r", "\r\n", "▁", "\0", "a", "the", "Wörter", "日本", "é", "12", "3.5", ");", "{", "}", "<s>", "</s>", "<unk>", "<0x0A>", "😀", "　", "​", "é", "ﬁ", "*/", "----", "\x85", "    ", "ation"]


@pytest.fixture(scope="module")
def model():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def test_pretokens_are_encoded_independently(model):
    rng = random.Random(3)
    counter = token_counts.PieceCounter(PIECES)
    for text in ["", " ", "  ", "\n", "\n\n", " \n ", *("".join(rng.choices(PARTS, k=rng.randint(1, 30))) for _ in range(4000))]:
        assert sum(counter.count(token_counts.pretokens(text))) == len(model.encode(text)), repr(text)


def test_token_counts_match_direct_encoding(spark, model, monkeypatch):
    rows = odd_docs() + [(900, "".join(random.Random(4).choices(PARTS, k=9000)), "x", 1, "x", 1, "x")]
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), PIECES)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = lambda t: len(model.encode(t or ""))
    assert Counter(map(tuple, got.collect())) == Counter((i, len((t or "").encode()), n(t), n(t) > 4096) for i, t, *_ in rows)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), PIECES).collect() == []
    blank = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(map(str, token_counts.token_counts(blank, PIECES).collect())) == sorted(
        ["Row(doc_id=1, n_bytes=0, n_tokens=0, over_limit=False)", "Row(doc_id=None, n_bytes=0, n_tokens=0, over_limit=False)"]
    )


def test_chunks_of_any_size_give_the_same(spark, model):
    # small chunks on the driver: the same pieces as the tasks, without Spark
    rows = odd_docs()
    counter = token_counts.PieceCounter(PIECES)
    for size in (1, 3, len(rows)):
        got = []
        for at in range(0, len(rows), size):
            chunk = token_counts._Chunk()
            for i, t, *_ in rows[at: at + size]:
                chunk.add(token_counts.pa.array([i], token_counts.pa.int64()), [(t or "").encode()])
            words = list(chunk.numbers)
            got += token_counts.sums(chunk.block(), np.array(counter.count(words), np.int64))[3].tolist()
        assert got == [len(model.encode(t or "")) for _, t, *_ in rows]


def test_models_whose_pieces_cross_borders_are_refused(monkeypatch):
    import sentencepiece

    class Odd:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁a", "a▁b"][i]

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError, match="cross"):
        token_counts.PieceCounter("x")


# ---- periodic runs --------------------------------------------------------------------------

def plain_runs(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_words(rng):
    k, w = rng.randint(1, 4), []
    for _ in range(rng.randint(1, 8)):
        u = [rng.randint(0, k) for _ in range(rng.randint(1, 12))]
        w += (u * 9)[: rng.randint(1, 9 * len(u))] if rng.random() < 0.6 else u
    return w


def test_runs_match_a_plain_search():
    rng = random.Random(1)
    twofold = [0]
    for _ in range(10):  # equal sums modulo a power of two: hashes of its halves meet
        twofold += [1 - x for x in twofold]
    cases = [some_words(rng) for _ in range(200)] + [twofold * 4, [1] * 900, [0, 1] * 700 + [0] * 300, [], [3]]
    for exponent, least in ((4, 6), (3, 3)):
        got = periodic.batch_runs([[str(x).encode() for x in c] for c in cases], exponent, least)
        assert got == [plain_runs(c, exponent, least) for c in cases]


def test_words_may_be_appended_in_any_pieces():
    rng = random.Random(8)
    for _ in range(25):
        words = some_words(rng)
        catchers, at = periodic.Catchers(len(words)), 0
        while at < len(words):
            step = rng.choice([1, 1, 2, 7])
            catchers.append(np.array(words[at: at + step], np.int64))
            at += step
        catchers.finish()
        assert [(s, e - s, q) for s, e, q in catchers.runs] == plain_runs(words)


def test_hashes_that_meet_do_not_make_runs():
    words = np.array([1, 2] * 6 + [3] + [1, 2] * 6, np.int64)
    catchers = periodic.Catchers(len(words))
    catchers.append(words)
    catchers.found.clear()
    catchers._report(np.array([0]), np.array([25]), np.array([2]))  # as if all hashes had been equal
    assert catchers.found == {(0, 12, 2), (13, 25, 2)}


def plain_row(doc, text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    runs = plain_runs(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)),
    )


def planted(doc, text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    h = zlib.crc32(("" if doc is None else str(doc)).encode())
    if h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[:a] + [w[a + (i - a) % p] for i in range(a, n)])


def test_periodic_rows_of_odd_documents(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t, *_ in odd_docs()] + [(k, " ".join(map(str, some_words(rng)))) for k in range(100, 300)]
    docs = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], "doc_id long, text string, start long, runs string, words int")
    made = made_periodic(docs)
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(((r["doc_id"], " ".join((r["text"] or "").split())) for r in made.collect()), key=key) == sorted(
        ((i, " ".join((planted(i, t) or "").split())) for i, t in rows), key=key
    )
    got = periodic.periodic_runs(made)
    picked = got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert Counter(map(tuple, picked.collect())) == Counter(plain_row(i, planted(i, t)) for i, t in rows)
    assert all(r["n_runs"] == len(r["runs"]) for r in got.collect())
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_word_queries_over_a_table(spark):
    from tests.conftest import SF

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    spelt = QUERIES["op11_spelling_variants"](spark, SF)
    assert sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelt.collect()) == plain_variants(plain_words(docs, True))
    runs = QUERIES["op13_periodic_runs"](spark, SF)
    assert runs.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [(i, t) for i, t in docs if len((t or "").split()) < 1500]
    got = {tuple(r) for r in runs.join(spark.createDataFrame([(i,) for i, _ in short], "doc_id long"), "doc_id").collect()}
    assert got == {plain_row(i, planted(i, t)) for i, t in short}
    assert QUERIES["op12_token_counts"](spark, SF).agg(F.count("*")).first()[0] == len(docs)
