import math
import random

from duewise.llm import toxicity as tx


def score(model, texts):
    m = tx.Machine(model.weights)
    return [float(m.features(t)[0] @ model.kinds + model.intercept) for t in texts]


PRIOR = tx.Model({}, tx.PRIOR_WEIGHTS, tx.PRIOR_INTERCEPT)


TOXIC = ["You are an idiot.", "I will kill you", "we're going to hurt them", "Shut up, idiots like you are worthless scum and you know it", "I'll destroy you!", "du bist ein idiot", "what a moron you are"]
FINE = [
    "idiot", "garbage collection", "the garbage truck", "Take out the trash.", "we kill time", "The verb kill is irregular", "you are not an idiot", "he said they are idiot material",
    "I will not hurt you", "She wrote that you are a moron", "we will destroy the wall", "what a fine day",
]


def test_clauses_not_words_are_scored():
    for texts, toxic in ((TOXIC, True), (FINE, False)):
        for text, z in zip(texts, score(PRIOR, texts), strict=True):
            assert (1 / (1 + math.exp(-z)) >= tx.THRESHOLD) == toxic, (text, z)


def test_targets_raise_insults_and_threats():
    a, b, c, d = score(PRIOR, ["I will hurt you", "they hurt you", "hurt the wall", "say hurt you"])
    assert a > b > c and b > d
    near, far = score(PRIOR, ["an idiot like you", "an idiot went to the market and there met you"])
    assert near > far


def test_composed_machine_equals_the_machines_in_a_row():
    machines = [tx.scoped((tx.TARGET, tx.SUBJECT), 6, "at"), tx.scoped((tx.NEGATION,), 3, "negated"), tx.scoped((tx.REPORT,), 1, "reported", True), tx.intended()]
    after, written = tx.compose(*machines)
    rng = random.Random(1)
    for _ in range(200):
        states, at = [0] * len(machines), 0
        for symbol in (rng.randrange(11) for _ in range(12)):
            now = (symbol,)
            for k, m in enumerate(machines):
                states[k], now = m.step(states[k], now)
            assert written[at][symbol] == now
            at = after[at][symbol]


def brute_clause(symbols):
    """Marks of each insult and threat in a clause, by looking at all words around it."""
    def last(k, wanted, reach):
        return any(symbols[j] in wanted for j in range(max(0, k - reach), k))

    out = {}
    for k, s in enumerate(symbols):
        if s in (tx.INSULT, tx.THREAT):
            at = last(k, (tx.TARGET, tx.SUBJECT), 6) or any(x == tx.TARGET for x in symbols[k + 1 : k + 4])
            out[k] = at, last(k, (tx.NEGATION,), 3), tx.REPORT in symbols[:k]
    return out


def test_matches_against_brute_force():
    rng, machine = random.Random(7), tx.Machine({})
    for _ in range(500):
        symbols = [rng.choice([tx.OTHER, tx.OTHER, tx.OTHER, tx.INSULT, tx.TARGET, tx.SUBJECT, tx.NEGATION, tx.REPORT]) for _ in range(rng.randint(1, 14))]
        got = machine.clause([(s, 3.0) for s in symbols])
        want = [(tx.INSULT, tx.SOMEBODY if at else tx.NOBODY, "negated" if no else "reported" if told else "asserted") for at, no, told in brute_clause(symbols).values()]
        if want:
            assert got[0] in {tx.KINDS.index(w) for w in want} and tx.PRIOR_WEIGHTS[got[0]] == max(tx.PRIOR_WEIGHTS[tx.KINDS.index(w)] for w in want)
        else:
            assert got is None


def test_learns_stems_and_meets_held_out_labels(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeimnor") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[10:14] = ["zuqi" + word() for _ in range(4)]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (0, rows[0][1], "x"), (None, "idiot", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (77777, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    test = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    right = [r["predicted"] == int(r["doc_id"] % 5 == 0) for r in test]
    assert len(test) > 200 and sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got)
    carried = PRIOR.score(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert carried.columns == ["doc_id", "text", "score", "_score", "n_clauses"]


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    model = tx.Model.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    assert got[1] > 0.7 > got[2]
    assert model.score(docs.limit(0)).count() == 0


def test_states_that_tell_nothing_can_go():
    rng = random.Random(5)
    words = ["".join(rng.choice("abki") for _ in range(rng.randint(1, 13))) for _ in range(600)] + [w for k in (tx.INSULT, tx.THREAT) for w in tx.PRIOR[k].split()]
    for share in (0.1, 0.5, 0.9):
        weights = {s: rng.uniform(-4, 6) if rng.random() < share else -1.0 for w in rng.sample(words, 400) for s in tx.beginnings(w) if rng.random() < 0.8}
        whole, short = tx.Machine(weights), tx.Machine(tx.telling(weights))
        assert len(short.weights) < len(weights)
        for w in words:
            assert whole.word(w) == short.word(w)
            assert whole.word(w + "ba") == short.word(w + "ba")
