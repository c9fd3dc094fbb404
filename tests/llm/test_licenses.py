import math
import random
import re

from duewise.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, threshold=0.8):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    hits, base = [], set()
    for phrase, label in lic.PHRASES.items():
        p = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        hits += at
        base |= {label} if at else set()
    blocks = [set(WORD.findall(b)) for b in [*re.split(r"\n[ \t\r]*\n", low), *low.split("\n")]]
    met = {}
    for block in blocks:
        best = {}
        for label, family, required, notice in lic.TEMPLATES:
            t = set(notice.split())
            if len(t & block) >= math.ceil(threshold * len(t) - 1e-9) and set(required.split()) <= block:
                best[family] = max(best.get(family, (0,)), (len(t & block) / len(t), len(t), label))
        for share, _, label in best.values():
            met[label] = max(met.get(label, 0), share)
    score = 1.0 if hits else max(met.values(), default=0.0)
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(met))), round(score, 9)


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    phrases = [t[3] for t in lic.TEMPLATES] + list(lic.PHRASES)
    texts = [None, "", "MIT\nLicense", "mit license MIT-License mit license", "Xmit license", "é mitélicense licensé", "The MIT license (apache\tlicense) General  Public, License!", "A" * 5000, "mit " * 4000 + "license", "mit license x"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(phrases).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["zz", "the", "license", "of"])
            if rng.random() < 0.3:
                rng.shuffle(w)
            parts.append(rng.choice([" ", ", ", "\n", "-"]).join(w).title())
        texts.append(rng.choice(["\n", "\n\n", "\n \n", " "]).join(parts))
    rows = [(k, t, "c") for k, t in enumerate(texts)] + [(0, None, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lic.op3_licenses(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (*r[1:7], round(r["score"], 9)) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
    kept = lic.scan(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0))
    assert "_score" in kept.columns and kept.count() == 0


def test_kin_are_told_apart(spark):
    want = {
        "Licensed under CC BY 4.0": "cc-by-4.0-notice",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-notice",
        "licensed under cc-by-nc-sa 4.0": "cc-by-nc-sa-4.0-notice",
        "This work is licensed under the GNU General Public License, version 2": "gpl,gpl-2.0-notice",
        "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0-notice",
        "He reserved a table and all rights to it": "",
        "Copyright 2020 X. All rights reserved.": "all-rights-reserved",
        "Released under the MIT License": "mit,mit-notice",
        "a license under the table": "",
    }
    frame = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["text"]: r["labels"] for r in lic.scan(frame).collect()}
    assert got == want
    assert {r["labels"] for r in lic.scan(frame, templates=[]).collect()} == {"", "gpl", "mit"}


def test_positions_rule_candidates_out(spark):
    templates = [("t", "f", "a", "a b c d e f g h i j")]
    counts = {w: k for k, w in enumerate("abcdefghij")}
    index = lic.Index(lic.plan(templates, counts, 0.8), counts)
    frame = spark.createDataFrame([("a b c d e f g h".split(),), ("a b x1 x2 x3 x4 x5 x6 x7".split(),), ("c d e f g h i j".split(),), ("d e f g h i j x".split(),)], "w array<string>")
    assert [r[0] for r in frame.select(index.candidates(frame["w"])).collect()] == [[0], [], [0], []]
