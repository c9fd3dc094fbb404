"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer turns words into symbols (insult, threat, target, subject, negation, report, speaker, modal, other, end of
clause); insults and threats carry a weight. Small transducers mark an insult or threat that stands after a target or subject,
in the scope of a negation, in reported speech, or after a speaker and a modal ("I will"); ``compose`` makes one machine of
them, which reads a clause forwards. One more reads it backwards and marks what has a target soon after it, so targets count on
both sides. A clause's path is its best match: an insult at somebody or at nobody; a threat meant, at somebody, or at nobody;
asserted, negated or reported. A document's score is a logistic function of its clauses' matches by kind, damped.

Learned from labels: the lexicon's weights, a trie of word beginnings whose states hold smoothed log odds of the label (so a
stem that marks toxic texts in any language counts, whatever its endings), and the logistic weights of the kinds, fitted on
the half of the sample that the lexicon at hand was not learned from. The fixed words below are only a prior: by it alone a
single word that isn't said at anybody is not toxic, but where the labels say that such words are, the weights follow them.

Bounds: at most ``sample_toxic`` and ``sample_clean`` labelled documents, those with the smallest seeded hashes, are learned
from, each text once; a trie state counts from ``least_docs`` toxic documents on. Every document is scored whole, in one map.

Edge cases: null and empty texts score the intercept; labels that are null or of unknown documents teach nothing, and of
repeated labels, and of equal texts, the largest counts; without labels of both kinds the prior alone is used; repeated
documents are scored each on its own; a null doc_id counts as not held out; an empty table gives an empty result. Label,
language, source and doc_id are never inputs of a score. ``score`` carries other columns along and renames its own on a clash.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.llm.common import fresh, frugal, table, written

OTHER, END, INSULT, THREAT, TARGET, SUBJECT, NEGATION, REPORT, SPEAKER, MODAL, INTENT = range(11)

#: Words known beforehand.
PRIOR: dict[int, str] = {
    INSULT: "idiot moron stupid scum trash loser pathetic worthless clown disgusting imbecile fool dumb garbage vermin "
    "dummkopf abschaum idioten crétin abruti ordure salaud estúpido imbécil escoria basura",
    THREAT: "kill destroy hurt crush murder slaughter töten vernichten tuer détruire écraser matar destruir aplastar",
    TARGET: "you your yours him them these those people du dich dir euch tu toi vous eux usted ustedes ti",
    SUBJECT: "he she they ihr sie er ils elles ellos ellas",
    NEGATION: "not never no don't isn't aren't won't nicht nie kein keine pas jamais aucun aucune nunca jamás ni",
    REPORT: "said says say wrote writes called calls claimed claims quoted quote sagte schrieb nannte disait écrit appelé dijo escribió llamó",
    SPEAKER: "i we i'm we're ich wir je nous yo nosotros",
    MODAL: "will shall going gonna must want werde werden will vais allons vamos voy quiero",
    INTENT: "i'll we'll",
}

NOBODY, SOMEBODY, MEANT = range(3)
KINDS = [(what, at, scope) for what, ats in ((INSULT, (NOBODY, SOMEBODY)), (THREAT, (NOBODY, SOMEBODY, MEANT))) for at in ats for scope in ("asserted", "negated", "reported")]
#: Prior logistic weight of each asserted kind, of others, and of weak words as a share of strong ones; prior intercept.
ASSERTED = {(INSULT, NOBODY): 4.0, (INSULT, SOMEBODY): 7.5, (THREAT, NOBODY): 1.0, (THREAT, SOMEBODY): 5.0, (THREAT, MEANT): 8.0}
PRIOR_WEIGHTS = np.array([strong * (ASSERTED[what, at] if scope == "asserted" else 0.8) for strong in (1.0, 0.1) for what, at, scope in KINDS])
PRIOR_INTERCEPT = -3.5

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,]")
LEAST, LONGEST = 3, 10
KEEP, STRONG = 1.0, 3.0  # log odds from which a word counts as an insult, and as a strong one


class Transducer:
    """Deterministic: reads a symbol and the marks others left on it, moves by the symbol and may add a mark of its own.

    ``arcs[state, symbol] = (next state, mark or None)``; for other symbols ``rest[state]`` is next.
    """

    def __init__(self, arcs: dict, rest: dict):
        self.arcs, self.rest = arcs, rest

    def step(self, state: int, marked: tuple) -> tuple[int, tuple]:
        after, mark = self.arcs.get((state, marked[0]), (self.rest[state], None))
        return after, (*marked, mark) if mark else marked


def scoped(openers: tuple, reach: int, mark: str, until_end: bool = False) -> Transducer:
    """Marks insults and threats up to ``reach`` words after an opener (or up to the end of the clause)."""
    arcs, rest = {}, {s: s if until_end else max(0, s - 1) for s in range(reach + 1)}
    for s in range(reach + 1):
        arcs |= {(s, o): (reach, None) for o in openers} | {(s, END): (0, None)}
        if s:
            arcs |= {(s, what): (rest[s], mark) for what in (INSULT, THREAT)}
    return Transducer(arcs, rest)


def intended(wait: int = 3, reach: int = 4) -> Transducer:
    """Marks threats up to ``reach`` words after a modal that stands up to ``wait`` words after a speaker."""
    last = wait + reach
    rest = {s: 0 if s in (0, wait + 1) else s - 1 for s in range(last + 1)}
    arcs = {}
    for s in range(last + 1):
        arcs |= {(s, SPEAKER): (wait, None), (s, INTENT): (last, None), (s, END): (0, None)}
        if s:
            arcs[s, MODAL] = (last, None)
        if s > wait:
            arcs[s, THREAT] = (rest[s], "meant")
    return Transducer(arcs, rest)


def compose(*machines: Transducer, symbols: range = range(11)) -> tuple[list[list[int]], list[list[tuple]]]:
    """The machines one after another as one: tables of next states and of what is written, by state and symbol."""
    start = (0,) * len(machines)
    number, order, after, written_ = {start: 0}, [start], [], []
    for state in order:
        row, out = [], []
        for symbol in symbols:
            now, parts = (symbol,), []
            for m, s in zip(machines, state, strict=True):
                s, now = m.step(s, now)
                parts.append(s)
            if (nxt := tuple(parts)) not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
            out.append(now)
        after.append(row)
        written_.append(out)
    return after, written_


def forwards() -> tuple[list[list[int]], list[list[tuple]]]:
    return compose(scoped((TARGET, SUBJECT), 6, "at"), scoped((NEGATION,), 3, "negated"), scoped((REPORT,), 1, "reported", True), intended())


def backwards() -> tuple[list[list[int]], list[list[tuple]]]:
    return compose(scoped((TARGET,), 3, "at"))


def kind_of(marks: tuple) -> int:
    """Index in KINDS of a match with its marks from both readings."""
    what = marks[0]
    at = (MEANT if "meant" in marks and what == THREAT else SOMEBODY) if "at" in marks else NOBODY
    return KINDS.index((what, at, "negated" if "negated" in marks else "reported" if "reported" in marks else "asserted"))


def prior_symbols() -> dict[str, int]:
    return {w: s for s, words in PRIOR.items() for w in words.split()}


def beginnings(word: str) -> list[str]:
    """The trie states of a word: its beginnings of LEAST to LONGEST letters, and the word itself (marked by a ``$``)."""
    return [word[:k] for k in range(LEAST, min(len(word), LONGEST) + 1)] + [word + "$"]


def trie_weights(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log odds of each state, smoothed from state to state; classes count as equally large. ``counts``: toxic and clean documents."""
    known, rates, out = prior_symbols(), {}, {}
    scale = toxic / max(clean, 1)
    for state in sorted(counts, key=lambda s: (s.endswith("$"), len(s), s)):
        word = state.removesuffix("$")
        above = word[:LONGEST] if state.endswith("$") else word[:-1]
        before = rates.get(above, 0.5)
        if state.endswith("$") and known.get(word) in (INSULT, THREAT):
            before = 0.97
        p, n = counts[state]
        rates[state] = (p + 2 * before) / (p + n * scale + 2)
        out[state] = math.log(rates[state] / (1 - rates[state])) if rates[state] < 1 - 1e-9 else 20.0
    return out


def telling(weights: dict[str, float]) -> dict[str, float]:
    """``weights`` less the states that leave a word as plain as the state above them does: every word reads as before."""
    known = {s for word, symbol in prior_symbols().items() if symbol in (INSULT, THREAT) for s in beginnings(word)}

    def needed(state: str) -> bool:
        word, longest = (state[:-1], LONGEST) if state.endswith("$") else (state, len(state) - 1)
        above = next((weights[word[:k]] for k in range(min(len(word), longest), LEAST - 1, -1) if word[:k] in weights), 0.0)
        return above >= KEEP

    return {s: w for s, w in weights.items() if w >= KEEP or s in known or needed(s)}


class Machine:
    """Reads texts in one worker: lexicon and composed grammar."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, prior_symbols()
        self.after, self.marks = forwards()
        self.before, self.marks_before = backwards()
        self.memo: dict[str, list[tuple[int, float]]] = {}
        self.kinds: dict[tuple, int] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a word: what the deepest state of its path says, else the prior."""
        symbol = self.known.get(word, OTHER)
        if symbol not in (OTHER, INSULT, THREAT):
            return symbol, 0.0
        for state in reversed(beginnings(word)):
            if (w := self.weights.get(state)) is not None:
                return (symbol or INSULT, min(w, 6.0)) if w >= KEEP else (OTHER, 0.0)
        return (symbol, 3.0) if symbol else (OTHER, 0.0)

    def chunk(self, chunk: str) -> list[tuple[int, float]]:
        """Symbols of a chunk between blanks; None stands for a plain word, the usual case."""
        if chunk not in self.memo:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
            got = [(END, 0.0) if len(w) == 1 and w in ".!?;:," else self.word(w) for w in WORD.findall(chunk)]
            self.memo[chunk] = PLAIN if got == PLAIN else got
        return self.memo[chunk]

    def clause(self, clause: list[tuple[int, float]]) -> tuple[int, float] | None:
        """Kind and weight of the best match of a clause, None if it has none."""
        state, marks = 0, {}
        for k, (symbol, _) in enumerate(clause):
            if symbol in (INSULT, THREAT):
                marks[k] = self.marks[state][symbol]
            state = self.after[state][symbol]
        if not marks:
            return None
        state, best = 0, None
        for k in range(len(clause) - 1, -1, -1):
            symbol, weight = clause[k]
            if k in marks:
                found = marks[k] + self.marks_before[state][symbol][1:]
                if (kind := self.kinds.get(found)) is None:
                    kind = self.kinds[found] = kind_of(found)
                path = (PRIOR_WEIGHTS[kind] * weight, weight, -k, kind)
                best = path if best is None or path > best else best
            state = self.before[state][symbol]
        return best[3], best[1]

    def features(self, text: str | None) -> tuple[np.ndarray, int]:
        """Damped sums of the weights of strong and of weak clauses by kind, and number of clauses with a match."""
        out, clauses = np.zeros(2 * len(KINDS)), 0
        for line in (text or "").lower().split("\n"):
            parts = line.split()
            if not any(s in (INSULT, THREAT) for c in set(parts) for s, _ in self.chunk(c)):
                continue
            clause: list[tuple[int, float]] = []
            for read in [x for c in parts for x in self.chunk(c)] + [(END, 0.0)]:
                if read[0] != END:
                    clause.append(read)
                    continue
                if best := self.clause(clause):
                    kind, weight = best
                    out[kind if weight >= STRONG else kind + len(KINDS)] += weight / STRONG
                    clauses += 1
                clause = []
        return np.log1p(out), clauses


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps, drawn towards the prior."""
    prior = np.append(PRIOR_WEIGHTS, PRIOR_INTERCEPT)
    if len(y) == 0 or y.min() == y.max():
        return PRIOR_WEIGHTS, PRIOR_INTERCEPT
    a, w = np.hstack([x, np.ones((len(x), 1))]), prior.copy()
    pull = np.append(np.full(x.shape[1], ridge), 0.05 * ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (y - p) - pull * (w - prior))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Counts that a task keeps before it sends them on, and chunks that a machine remembers: bounds of memory, results don't change.
HELD, REMEMBERED = 100_000, 50_000
PLAIN = [(OTHER, 0.0)]


class Model:
    """A lexicon and logistic weights, learned from labelled documents."""

    def __init__(self, weights: dict[str, float], kinds: np.ndarray, intercept: float):
        self.weights, self.kinds, self.intercept = weights, kinds, intercept

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, *, sample_toxic: int = 6_000, sample_clean: int = 10_000, least_docs: int = 3, seed: int = 11) -> Model:
        """``docs``: doc_id, text; ``labels``: doc_id, toxic. Learns from a sample of at most the given sizes."""
        spark = docs.sparkSession
        usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        drawn = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n) for y, n in ((1, sample_toxic), (0, sample_clean))]
        ids = [(r["doc_id"], int(r["toxic"])) for d in drawn for r in d.collect()]
        chosen = spark.createDataFrame(ids, "doc_id long, toxic int")
        sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
        sample = sample.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("h2")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
        sample = written(sample.withColumn("fold", F.pmod(F.col("h"), F.lit(2)).cast("int")))

        def counts_of(seen: dict[tuple[int, str], list[int]]) -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_pydict(
                {"fold": pa.array([k[0] for k in keys], pa.int32()), "state": pa.array([k[1] for k in keys], pa.string()), "p": pa.array([seen[k][1] for k in keys], pa.int64()), "n": pa.array([seen[k][0] for k in keys], pa.int64())}
            )

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])
            for batch in batches:
                for text, toxic, fold in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), batch["fold"].to_pylist(), strict=True):
                    words = set(re.findall(r"[^\W\d_]{%d,}" % LEAST, (text or "").lower()))
                    for s in {s for w in words for s in beginnings(w)}:
                        seen[fold, s][toxic] += 1
                    seen[fold, ""][toxic] += 1
                    if len(seen) >= HELD:  # parts of counts go on to the sum, so that a task's memory doesn't follow its rows
                        yield counts_of(seen)
                        seen.clear()
            yield counts_of(seen)

        per = sample.select("text", "toxic", "fold").mapInArrow(frugal(counted), "fold int, state string, p long, n long").groupBy("fold", "state").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        both = per.groupBy("state").agg(*[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in (0, 1) for c in ("p", "n")])
        kept = both.filter((F.col("p0") + F.col("p1") >= least_docs) | (F.col("state") == ""))
        counts: list[dict[str, tuple[int, int]]] = [{}, {}, {}]
        for r in kept.toLocalIterator(prefetchPartitions=True):
            counts[0][r["state"]], counts[1][r["state"]] = (r["p0"], r["n0"]), (r["p1"], r["n1"])
            counts[2][r["state"]] = r["p0"] + r["p1"], r["n0"] + r["n1"]
        lexicons = []
        for c in counts:
            toxic, clean = c.pop("", (0, 0))
            lexicons.append(telling(trie_weights(c, toxic, clean)) if toxic and clean else {})
        sent = spark.sparkContext.broadcast(lexicons[:2])

        def seen_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = [Machine(sent.value[1]), Machine(sent.value[0])]
            for batch in batches:
                rows = [machines[f].features(t)[0] for t, f in zip(batch["text"].to_pylist(), batch["fold"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch["toxic"]], names=["x", "toxic"])

        rows = sample.select("text", "toxic", "fold").mapInArrow(frugal(seen_by), "x array<double>, toxic int").collect()
        rows.sort(key=lambda r: (r["toxic"], r["x"]))
        x = np.array([r["x"] for r in rows]).reshape(len(rows), 2 * len(KINDS))
        kinds, intercept = logistic(x, np.array([r["toxic"] for r in rows], float))
        return cls(lexicons[2], kinds, intercept)

    def score(self, docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
        """``docs`` (or its columns ``keep``) with score and n_clauses, the clauses that matched."""
        keep = docs.columns if keep is None else keep
        names = [fresh("score", keep), fresh("n_clauses", keep)]
        sent = docs.sparkSession.sparkContext.broadcast((self.weights, self.kinds, self.intercept))
        at = keep.index(text) if text in keep else len(keep)
        out = T.StructType([*(docs.schema[c] for c in keep), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, kinds, intercept = sent.value
            machine = Machine(weights)
            for batch in batches:
                scores, clauses = [], []
                for t in batch.column(at):
                    x, n = machine.features(t.as_py())
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ kinds) + intercept)))))
                    clauses.append(n)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array(clauses, pa.int32())], names=[*keep, *names])

        sources = keep if text in keep else [*keep, text]
        return docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(sources)]).mapInArrow(frugal(run), out)


THRESHOLD = 0.7


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = Model.fit(docs, table(spark, sf_dir, "labels")).score(docs, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")
