import gzip
import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import chat, warc
from ledgerwatch.llm.common import folder
from ledgerwatch.llm.records import FRAME, INDEX, Encoder, crc32c, frame, masked, pieces, read_range, token_output, unframe, write_records
from tests.llm.plain import SCHEMA, odd_docs

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_crc32c_known_values():
    data = np.frombuffer(b"123456789" + bytes(32) + b"\xff" * 32, np.uint8)
    assert crc32c(data, np.array([0, 9, 41]), np.array([9, 32, 32])).tolist() == [0xE3069283, 0x8A9136AA, 0x62A8AB43]
    assert masked(np.array([0], np.uint32)).tolist() == [0xA282EAD8]


def test_crc32c_of_any_length():
    rng = np.random.default_rng(0)
    table = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        table[i] = c
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts, lengths = np.array([0, 5, 100, 7, 2000]), np.array([4, 63, 64, 2500, 65])
    want = []
    for s, n in zip(starts, lengths):
        c = 0xFFFFFFFF
        for b in data[s: s + n].tolist():
            c = table[(c ^ b) & 255] ^ (c >> 8)
        want.append(c ^ 0xFFFFFFFF)
    assert crc32c(data, starts, lengths).tolist() == want


def test_pieces_encode_like_whole_texts(tokenizer):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", " ", "　", "\x1f", "\x00", "a", "word", "Wörter,", "it's", "'ll", "12", "3a", ".", "!?", "<|endoftext|>", "日本", "é.", "_", "ªº,", "x,"]
    texts = ["", " ", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(800))]
    found = Encoder(PATH).batch(texts)
    for text, ids in zip(texts, found):
        assert "".join(pieces(text)) == text
        assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_new_words_are_encoded_many_at_a_time(tokenizer, monkeypatch):
    """Distinct words go to the library as lines of a few texts; marks and line feeds part them; forgetting changes nothing."""
    from ledgerwatch.llm import records

    class Counting:
        texts = 0

        def encode_batch_fast(self, texts, **kw):
            self.texts += len(texts)
            return tokenizer.encode_batch_fast(texts, **kw)

    rng = random.Random(5)
    tokenizer.encode_special_tokens = True
    words = ["".join(rng.choice("abeéßÿñ") for _ in range(8)) for _ in range(3000)]
    texts = [" ".join(w + rng.choice(["", ".", "***", ".\nIn", "'s", "\n\n", "!'ll", "\n"]) for w in words[k: k + 300]) for k in range(0, 3000, 300)] + ["", "\n", " \n "]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    for limit in (600_000, 10):
        monkeypatch.setattr(records, "REMEMBERED", limit)
        encoder = Encoder(PATH)
        encoder.tokenizer = Counting()
        assert encoder.batch(texts) == want and encoder.batch(texts[::-1]) == want[::-1]
        if limit > 10:
            assert encoder.tokenizer.texts < 1500


def test_frames_round_trip_and_notice_damage():
    ids = [5, None, -3]
    tokens = [np.arange(k, dtype="<u2").tobytes() for k in (1, 0, 300)]
    raw, at = frame(ids, tokens, np.dtype("<u2"))
    back = unframe(raw, at)
    assert [i for i, _ in back] == ids and [t.tolist() for _, t in back] == [list(range(k)) for k in (1, 0, 300)]
    for place in (0, FRAME.itemsize + 2, len(raw) - 1):
        broken = bytearray(raw)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            unframe(bytes(broken), at)


def test_token_output_matches_direct_encoding(spark, tokenizer):
    rows = odd_docs()
    got = token_output(spark.createDataFrame(rows, SCHEMA), PATH)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    own = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    want = Counter((i, len(own(t)), zlib.crc32(np.array(own(t), "<u4").tobytes())) for i, t, *_ in rows)
    found = sorted(got.collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    assert [r["doc_id"] for r in found] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in found])])[:-1].tolist()


def test_shuffled_reads_by_the_index(spark, tokenizer):
    docs = spark.createDataFrame([(k, f"text number {k} " * (k % 5)) for k in range(200)], "doc_id long, text string")
    base = folder(spark, "records-test")
    files = write_records(docs, base, PATH).collect()
    for f in files:
        for at in random.Random(0).sample(range(f["records"]), min(8, f["records"])):
            rows, ((doc, tokens),) = read_range(base, f["file"], f["index"], at, 1)
            assert len(rows) == 2 and rows.dtype == INDEX and rows["id"][0] == doc
            assert tokens.tolist() == tokenizer.encode(f"text number {doc} " * (doc % 5), add_special_tokens=False).ids + [2]


def test_token_output_of_no_rows(spark):
    assert token_output(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def plain_turns(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), x or ""))
    out = set()
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r[1]}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == (True, "assistant"))
        out.add((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_chat_digests_of_odd_conversations(spark):
    rng = random.Random(3)
    marks = [m for m, _ in chat.CONTROL] + ["a", "\\", "\n", "ü", " ", "\\a", "<|>", "|>", "<<", "[/INST]]", "<</SYS>>"]
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", None, "to\nol", "<|says|>"]), rng.choice([None, "", "".join(rng.choice(marks) for _ in range(rng.randint(1, 900)))]))
        for c in range(25) for t in range(rng.randint(1, 6))
    ]
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (None, 0, "user", "x"), (None, None, "assistant", "y"), (8, 0, "assistant", None)]
    frame_ = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, seq int")
    got = chat.chat(frame_)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {tuple(r)[:5] for r in got.collect()} == plain_turns(rows)


def test_fold_of_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "open", "user", None), (1, 1, 0, "delta", None, "he"), (1, 2, 0, "delta", None, "llo"),
        (1, 3, 1, "open", "assistant", None), (1, 4, 1, "delta", None, "draft"), (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", None, "fi"), (1, 7, 1, "edit", None, "new "), (1, 8, 1, "delta", None, "text"), (1, 9, 1, "delta", None, None),
        (1, 10, 0, "edit", None, "bye"),
    ]
    random.Random(1).shuffle(events)
    log = spark.createDataFrame([(c, s, t, 0, k, r, x) for c, s, t, k, r, x in events], "conv_id long, seq long, turn long, copy int, kind string, role string, text string")
    found = chat.fold_events(log)
    assert {(r["turn"], r["role"], r["text"]) for r in found.collect()} == {(0, "user", "bye"), (1, "assistant", "new text")}
    (row,) = chat.format_conversations(found).collect()
    assert row["formatted"] == "<|turn|>user<|says|>bye<|end|><|turn|>assistant<|says|>new text<|end|>"
    assert [tuple(m) for m in row["loss_mask"]] == [(2, 26, 8)]


def test_escaped_texts_hold_no_control_string(spark):
    texts = [m for m, _ in chat.CONTROL] + ["<s></s>[INST][/INST]<<SYS>><</SYS>><|turn|><|end|>\\a\\\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(m in r["e"] for m, _ in chat.CONTROL[1:])


def test_chat_of_no_rows(spark):
    assert chat.chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def odd_pages():
    long, other = "<p>" + "long page " * 30, "ä" * 60
    rows = [(k, f"http://www.Example{k % 3}.org/a/{k}?q=1", long if k % 3 else other) for k in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x.org/1", "short"), (103, "http://x.org/2", "short"), (104, "https://user@a.b.c:80/x", long), (105, "no host", "\r\n\r\n" * 40), (105, "no host", "\r\n\r\n" * 40)]
    rows += [(None, "http://x.org/3", long), (106, 'http://x.org/"\n\\é', "z" * 200), (107, "http://x.org/1", "other" * 40)]
    return rows


def test_warc_round_trip(spark):
    rows = odd_pages()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 100 and h in first and first[h] != i
        want[(i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    got = warc.warc(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string"))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_warc_lookup_by_two_levels(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = odd_pages() + [(k, "http://hot.org/same", f"page {k}") for k in range(1000, 1020)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    base = folder(spark, "warc-test")
    directory = warc.write_archives(pages, base)
    wanted = ["http://www.Example1.org/a/4?q=1", "http://hot.org/same", "http://x.org/1", 'http://x.org/"\n\\é', "http://nowhere.org/", None]
    got = warc.lookup(directory, base, spark.createDataFrame([(u,) for u in wanted], "url string"))
    found = Counter(r["url"] for r in got.collect())
    assert found == Counter(u for _, u, _ in rows if u in wanted or not u)


def test_warc_record_is_a_gzip_member():
    raw = warc.record(7, "http://a.b/", "d", 3, "revisit", 5, None)
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    head, payload = warc.parse(raw)
    assert head["WARC-Refers-To"] == "<urn:page:5>" and payload == b"" and json.loads(f'"{head["WARC-Target-URI"]}"') == "http://a.b/"
    with pytest.raises(ValueError):
        warc.parse(warc.record(7, None, "wrong digest", 3, "response", None, b"abc"))


def test_warc_keys(spark):
    urls = ["http://www.A.org/x", "https://u:p@b.c:8/y?z", None, "", "plain"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["org,a,www)/x", "c,b):8/y?z", ")", ")", "plain)"]


def test_warc_of_no_rows(spark):
    assert warc.warc(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
