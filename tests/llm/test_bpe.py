import functools
import hashlib
import random

import duckdb
import pytest
from tokenizers import Tokenizer

from duewise.llm import bpe

PATH = bpe.vocabulary_path()
WORST = [
    None, "", "   ", "Hello, WORLD! it's they're don't 12,345", "ΣΊΣΥΦΟΣ İstanbul ǅ ﬁ Straße", "a\x1cb\x1dc \x85 d e​f　g", "x<|endoftext|>Y <|startoftext|><|endoftext|",
    "été ç", "日本語テキスト 한국어 עברית", "👩‍👩‍👧 🎉🎉!!!", "\x00\x01\x7f", "'S 'Re 'LL''d", "ⅷ ½ ٣٤", "a" * 5000, "the " * 3000,
]


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


def expected(text):
    t = library()
    got = t.encode(text or "", add_special_tokens=False)
    return len(got.ids), " ".join(map(str, got.ids)), t.decode(got.ids, skip_special_tokens=False)


def codec(words):
    v = bpe.Vocabulary(PATH)
    return bpe.Codec(v, bpe.Lexicon.mapped(bpe.Lexicon.build({w: v.merge(w) for w in words})))


@pytest.mark.parametrize("words", [[], ["hello", "the", "they", "then", "aaaa", "été", "日本語テキスト"]])
def test_worst_texts_match_the_library(words):
    c = codec(words)
    for text in WORST:
        assert c.text(text) == expected(text), text


def test_random_texts_match_the_library():
    rng, c = random.Random(5), codec(["the", "and", "ab", "abc", "cab"])
    letters = "abcçéßΣσİı '’́\t\n \x1f0９٣!?.-_<>|日한א👍\U0001d7d9"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert c.text(text) == expected(text), repr(text)


def test_the_automaton_holds_exactly_its_words_and_shares_suffixes():
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)}
    data = bpe.Lexicon.build({w: [k, k + 1] for k, w in enumerate(sorted(words))})
    lexicon = bpe.Lexicon.mapped(data)
    for k, w in enumerate(sorted(words)):
        assert lexicon.find(w) == [k, k + 1]
    for _ in range(500):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))
        assert (lexicon.find(w) is None) == (w not in words)
    plain = bpe.Lexicon(bpe.Lexicon.build({a + "tion": [1] for a in "abcdefgh"}))
    assert len(plain.final) == 6  # start, and one chain for the common ending


def test_query_over_a_whole_table_and_edge_rows(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(WORST)] + [(0, None, "x")], "doc_id long, text string, token_ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = bpe.op10_bpe(spark, str(tmp_path)).collect()
    assert len(rows) == len(WORST) + 1
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        n, ids, decoded = expected(WORST[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (n, sha(ids), sha(decoded))
    got = bpe.Operator(docs, PATH, words=10).encode(docs).filter("doc_id = 3").first()
    assert " ".join(map(str, got["_token_ids"])) == expected(WORST[3])[1] and got["token_ids"] == "x"
    assert bpe.Operator(docs.limit(0), PATH).digests(docs.limit(0)).count() == 0


def test_sf_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    for i, text in duckdb.sql(f"select doc_id, text from '{path}'").fetchall():
        assert got[i] == hashlib.sha256(expected(text)[1].encode()).hexdigest()


def test_lexicon_words_are_those_over_a_count(spark):
    rows = [(" ".join(["aa"] * 9 + ["bb"] * 5 + ["cc"] * 5 + ["dd"] * 4 + ["ee"]),)]
    frame = spark.createDataFrame(rows, "text string")
    for size, want in [(0, []), (1, ["aa"]), (2, ["aa"]), (3, ["aa", "bb", "cc"]), (4, ["aa", "bb", "cc", "dd"]), (9, ["aa", "bb", "cc", "dd"])]:
        assert bpe.lexicon_words(frame, size) == want


def test_a_worker_remembers_and_holds_little():
    """Unseen words don't fill a worker (two share an executor with the JVM's heap), and what a task has freed goes back."""
    import re
    from pathlib import Path

    from duewise.llm.common import frugal

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    c = codec(["hello"])
    before = held()
    for k in range(0, 200_000, 500):
        text = " ".join(f"q{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}{'abcdefghij'[k // 500 % 10]}{'klmnopqrst'[k // 5000 % 10]}{'uvwxyzabcd'[k // 50000]}" for j in range(500))
        c.text(text)
        assert len(c.memo) <= 61_000
    assert held() - before < 60

    def run(batches):
        parts = [bytes(100_000) for _ in range(2000)]  # too small for a mapping of their own
        last = bytes(1000)
        yield from batches
        assert len(parts) and last

    floor = held()
    assert list(frugal(run)(iter([1, 2]))) == [1, 2]
    assert held() - floor < 40
