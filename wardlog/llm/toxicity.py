"""Toxicity: a weighted finite-state grammar over clauses, with an insult lexicon learned from labelled documents.

A chain of transducers. The lexicon transducer reads a word and gives all its tags (insult, threat, target, negation, report, self) and a
weight. Scope transducers read tags and mark words: negation and target for REACH words, reported speech to the end of the clause. They are
composed into one machine with a table of states (`compose`), which reads a clause from left to right; a second machine reads it from
right to left and marks words in front of a target or of the speaker (what follows a word cannot be known from the left). The weight
transducer turns the marks of a word into a factor: negation and reported speech scale down, a target scales up, a threat without a target or
against the speaker counts nothing. Clauses with a weight are matched; a document's score is a logistic function of
their weights, calibrated on labelled rows.

Insult stems with their weights come from other labelled rows: the log-odds of a stem (a word beginning or a whole word) between
toxic and clean documents. Stems are chosen one after the other, each for the toxic documents that those before do not explain; so the
words of a toxic text of which there are many copies do not become insults.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.lineage import settle
from wardlog.llm.common import SLICE_ROWS, keep_rows, map_slices, rows_out

#: Labelled rows that the fit reads at most, about; of larger label tables an even share by a hash of the id.
FIT_ROWS = 40_000
#: Candidate stems, and so stems of the grammar, at most; the strongest first.
MAX_STEMS = 8_000
MIN_SUPPORT = 3
#: A feature's likelihood ratio must exceed twice the logarithm of the number of features by this.
CHANCE = 4.0
#: Rows that the odds of a stem are worth against those of a longer form of it.
DRAW = 4.0
STEM_CHARS = (4, 5, 6, 7)
#: Lexicons of the grammar (fixed values); insults are added to by the fit.
INSULTS = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile "
                    "dumb fool bastard idiota estúpido imbécil crétin débile salaud dummkopf trottel arschloch".split())
THREATS = frozenset("kill hurt destroy beat stab shoot burn murder töten umbringen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours u they them he she du ihr euch dich tu toi vous tú ti usted ustedes".split())
NEGATIONS = frozenset("not no never neither nor nobody none nothing isn aren wasn don nicht kein keine nie niemand ne pas jamais personne nunca nadie".split())
REPORTS = frozenset("said say says saying wrote write writes claimed claims quoted quotes called calls reported reports sagte sagen sagt schrieb "
                    "schreibt dit disent écrit dijo dice dicen escribió".split())
SPEAKER = frozenset("me myself us mich mir uns moi nous mí nosotros".split())
LEXICONS = {"insult": INSULTS, "threat": THREATS, "target": TARGETS, "negation": NEGATIONS, "report": REPORTS, "self": SPEAKER}
#: Scale of a weight inside a scope, next to a target; words that a scope or a target reaches.
NEGATED, REPORTED, TARGETED, REACH = 0.4, 0.6, 1.25, 4
STATIC_WEIGHT, THREAT_WEIGHT = 4.0, 3.0
WORD = re.compile(r"[^\W\d_]+|[.!?;\n]")
ENDS = frozenset(".!?;\n")


#: Tags of a word, and marks that the scope transducers give it, as bits.
INSULT, THREAT, TARGET, NEGATION, REPORT, SELF = TAGS = tuple(1 << k for k in range(6))
IS_NEGATED, IS_REPORTED, IS_TARGETED, IS_SELF = MARKS = tuple(1 << k for k in range(4))
#: Highest log-odds of a text without any matched clause, whatever share of the calibration rows is toxic.
NO_CLAUSE = -1.0

#: A transducer: for each state (0 is the start) and each set of tags the next state and the marks of the word read.
Transducer = list[list[tuple[int, int]]]


def scope(opener: int, mark: int, reach: int) -> Transducer:
    """Marks the `reach` words after a word tagged `opener`; the state is the number of words still to be marked."""
    return [[(reach if tags & opener else max(0, left - 1), mark if left else 0) for tags in range(1 << len(TAGS))] for left in range(reach + 1)]


def scope_to_end(opener: int, mark: int) -> Transducer:
    """Marks all words of the clause after a word tagged `opener`."""
    return [[(1 if opened or tags & opener else 0, mark if opened else 0) for tags in range(1 << len(TAGS))] for opened in (0, 1)]


def compose(*parts: Transducer) -> Transducer:
    """One transducer that goes through the reachable combinations of states of all parts and gives all their marks."""
    number, table, todo = {(0,) * len(parts): 0}, [], [(0,) * len(parts)]
    while len(table) < len(todo):
        states, row = todo[len(table)], []
        for tags in range(1 << len(TAGS)):
            arcs = [part[state][tags] for part, state in zip(parts, states, strict=True)]
            after = tuple(a[0] for a in arcs)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append((number[after], sum(a[1] for a in arcs)))
        table.append(row)
    return table


FORWARD = compose(scope(NEGATION, IS_NEGATED, REACH), scope_to_end(REPORT, IS_REPORTED), scope(TARGET, IS_TARGETED, REACH))
BACKWARD = compose(scope(TARGET, IS_TARGETED, REACH), scope(SELF, IS_SELF, 1))


def read(machine: Transducer, tags: list[int]) -> list[int]:
    """Marks of every word."""
    state, out = 0, []
    for t in tags:
        state, marks = machine[state][t]
        out.append(marks)
    return out


def factor(tags: int, marks: int) -> float:
    """What the weight of a word counts under its marks."""
    if not tags & INSULT and (not marks & IS_TARGETED or marks & IS_SELF):
        return 0.0
    return (NEGATED if marks & IS_NEGATED else 1.0) * (REPORTED if marks & IS_REPORTED else 1.0) * (TARGETED if marks & IS_TARGETED else 1.0)


@dataclass
class Grammar:
    """Lexicons, weighted stems and the calibration; `score` needs nothing but a text."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-3.0, 1.0, 0.0)
    lexicons: dict[str, frozenset[str]] = field(default_factory=lambda: dict(LEXICONS))

    def insult(self, word: str) -> float:
        """The weight of the whole word as an insult, else of its longest known beginning."""
        if (weight := self.words.get(word)) is not None:
            return weight
        best = STATIC_WEIGHT if word in self.lexicons["insult"] else 0.0
        for size in STEM_CHARS[::-1]:
            if len(word) >= size and (weight := self.stems.get(word[:size])) is not None:
                return max(best, weight)
        return best

    def tag(self, word: str) -> tuple[int, float]:
        """Output of the lexicon transducer: all tags of a word, and its weight."""
        tags = sum(bit for name, bit in zip(LEXICONS, TAGS, strict=True) if bit != INSULT and word in self.lexicons[name])
        weight = self.insult(word)
        if weight > 0:
            return tags | INSULT, weight
        return tags, THREAT_WEIGHT if tags & THREAT else 0.0

    def clauses(self, text: str | None) -> list[float]:
        """Weights of the matched clauses of a text."""
        found, memo = [], self._memo()
        tags: list[int] = []
        weighted: list[tuple[int, float]] = []
        for word in [*WORD.findall(text.lower()), "."] if text else ():
            if word in ENDS:
                if weighted and (total := self._weigh(tags, weighted)) > 0:
                    found.append(total)
                tags, weighted = [], []
                continue
            known = memo.get(word)
            if known is None:
                if len(memo) > 500_000:
                    memo.clear()
                known = memo[word] = self.tag(word)
            if known[1] > 0:
                weighted.append((len(tags), known[1]))
            tags.append(known[0])
        return found

    @staticmethod
    def _weigh(tags: list[int], weighted: list[tuple[int, float]]) -> float:
        before, after = read(FORWARD, tags), read(BACKWARD, tags[::-1])[::-1]
        return sum(weight * factor(tags[at], before[at] | after[at]) for at, weight in weighted)

    def _memo(self) -> dict:
        if not hasattr(self, "_tags"):
            self._tags = {}
        return self._tags

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tags"}

    def score(self, weights: list[float]) -> float:
        """Probability from the clause weights of a text."""
        bias, total, top = self.coefficients
        a, b = features(weights)
        z = bias + total * a + top * b if weights else min(bias, NO_CLAUSE)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def features(weights: list[float]) -> tuple[float, float]:
    return min(sum(weights), 30.0), max(weights, default=0.0)


def held_out(doc_id: object) -> int:
    """crc32 of the id as text, modulo 5; 0: never learned from."""
    return zlib.crc32(str(doc_id).encode()) % 5


def fold_of(doc_id):
    """The same as a column."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def word_features(text: str | None) -> set[str]:
    """Words of three letters and more, and their beginnings marked with `*`."""
    words = set(re.findall(r"[^\W\d_]{3,}", text.lower())) if text else set()
    return words | {w[:n] + "*" for w in words for n in STEM_CHARS if len(w) >= n}


def _feature_counts(docs: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents with the feature, pre-summed per batch."""
    arrow = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                for text, label in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    counts[0 if label else 1].update(word_features(text))
            names = list(counts[0].keys() | counts[1].keys())
            yield rows_out(arrow, [names, [counts[0][n] for n in names], [counts[1][n] for n in names]])

    return docs.select("text", "toxic").mapInArrow(run, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _incidence(docs: DataFrame, names: list[str]) -> list[tuple[int, np.ndarray]]:
    """(label, numbers of the candidate features present) of every row of the bounded sample."""
    number = {n: k for k, n in enumerate(names)}
    arrow = pa.schema([("toxic", pa.int32()), ("present", pa.binary())])

    def run(piece: pa.RecordBatch) -> list:
        present = [np.array(sorted(number[f] for f in word_features(t) if f in number), np.int32).tobytes() for t in piece.column(0).to_pylist()]
        return [piece.column(1).to_pylist(), present]

    return [(r["toxic"], np.frombuffer(bytes(r["present"]), np.int32)) for r in map_slices(docs.select("text", "toxic"), run, "toxic int, present binary", arrow).collect()]


def likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """Twice the log likelihood ratio of the feature's toxic share against the share of all rows."""
    share, both = all_toxic / max(1, all_toxic + all_clean), np.maximum(toxic + clean, 1)
    part = lambda n, p: np.where(n > 0, n * np.log(np.maximum(n, 1) / (both * max(p, 1e-12))), 0.0)
    return 2 * (part(toxic, share) + part(clean, 1 - share))


def choose_stems(names: list[str], rows: list[tuple[int, np.ndarray]], bound: float) -> dict[str, float]:
    """Features with their log-odds: each explains toxic rows beyond chance that none before it explains; then refinements of them."""
    toxic = [present for label, present in rows if label]
    clean = [present for label, present in rows if not label]
    total = np.bincount(np.concatenate(toxic or [np.zeros(0, np.int32)]), minlength=len(names)).astype(float)
    benign = np.bincount(np.concatenate(clean or [np.zeros(0, np.int32)]), minlength=len(names)).astype(float)
    odds = np.log((total + 0.5) / (len(toxic) + 1.0)) - np.log((benign + 0.5) / (len(clean) + 1.0))
    where: dict[int, list[int]] = defaultdict(list)
    for row, present in enumerate(toxic):
        for f in present.tolist():
            where[f].append(row)
    left, open_rows, chosen = total.copy(), set(range(len(toxic))), {}
    while open_rows:
        ratio = np.where((left >= MIN_SUPPORT) & (odds > 1.0), likelihood_ratio(left, benign, len(toxic), len(clean)), 0.0)
        # of equally good features the first by name
        best = int(ratio.argmax()) if len(ratio) else 0
        if not len(ratio) or ratio[best] <= bound:
            break
        chosen[names[best]] = float(odds[best])
        for row in open_rows.intersection(where[best]):
            left[toxic[row]] -= 1
            open_rows.discard(row)
    # longer beginnings and whole words of a chosen stem, drawn towards its odds
    scale = (len(toxic) + 1.0) / (len(clean) + 1.0)
    for stem in [n for n in chosen if n.endswith("*")]:
        pull = 1 / (1 + math.exp(-chosen[stem]))
        for k, name in enumerate(names):
            if name not in chosen and name.startswith(stem[:-1]):
                chosen[name] = math.log((total[k] + DRAW * pull) / (benign[k] * scale + DRAW * (1 - pull)))
    return {n: min(w, 7.0) for n, w in chosen.items()}


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic") -> DataFrame:
    """(text, toxic, fold 1..4) of labelled documents outside the held-out fold, about `fit_rows` at most; null labels are left out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"), fold_of(F.col(id_col)).alias("fold"))
    known = known.where("_id is not null and toxic is not null and fold <> 0")
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    # the share above bounds the broadcast side; the sample is kept, so that the documents are read once
    return settle(texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("text", "toxic", "fold"))


def fit_grammar(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_stems: int = MAX_STEMS, **columns: str) -> Grammar:
    """Learn stems on folds 1 to 3 and the calibration on fold 4; the defaults stay where there are too few labels."""
    rows = training_rows(docs, labels, fit_rows, **columns)
    learn = rows.where("fold <> 4")
    sizes = learn.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    toxic, clean = sizes["toxic"], sizes["n"] - sizes["toxic"]
    grammar = Grammar()
    if toxic >= 5 and clean >= 5:
        # features whose likelihood ratio is beyond chance for as many as are tried
        share, both = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
        ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * share))
                     + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0))
        tried = settle(_feature_counts(learn).where(F.col("toxic") >= MIN_SUPPORT).select(
            "feature", (F.col("toxic") / both > share).alias("raised"), ratio.alias("ratio")))
        bound = 2 * math.log(max(1, tried.count())) + CHANCE
        strong = tried.where((F.col("ratio") > bound) & F.col("raised")).orderBy(F.desc("ratio"), "feature").limit(max_stems).collect()
        names = sorted(r["feature"] for r in strong)
        for name, weight in choose_stems(names, _incidence(learn, names), bound).items():
            if name.endswith("*"):
                grammar.stems[name[:-1]] = weight
            else:
                grammar.words[name] = weight
    points = _clause_points(rows.where("fold = 4"), grammar)
    grammar.coefficients = _calibrate(points) or grammar.coefficients
    return grammar


def _clause_points(rows: DataFrame, grammar: Grammar) -> list[tuple[float, float, int, int]]:
    """Distinct rounded features with their counts of clean and toxic rows; the grid bounds their number."""
    arrow = pa.schema([("a", pa.float64()), ("b", pa.float64()), ("toxic", pa.int32())])

    def run(piece: pa.RecordBatch) -> list:
        values = [features(grammar.clauses(t)) for t in piece.column(0).to_pylist()]
        return [[round(a * 2) / 2 for a, _ in values], [round(b * 2) / 2 for _, b in values], piece.column(1).to_pylist()]

    found = map_slices(rows.select("text", "toxic"), run, "a double, b double, toxic int", arrow)
    return [tuple(r) for r in found.groupBy("a", "b").agg(F.sum(F.lit(1) - F.col("toxic")), F.sum("toxic")).collect()]


def _calibrate(points: list[tuple[float, float, int, int]]) -> tuple[float, ...] | None:
    """Ridge logistic regression by Newton steps; None without both labels."""
    if not points or not sum(p[2] for p in points) or sum(p[3] for p in points) < 3:
        return None
    x = np.array([[1.0, a, b] for a, b, _, _ in points] * 2)
    y = np.array([0.0] * len(points) + [1.0] * len(points))
    n = np.array([p[2] for p in points] + [p[3] for p in points], float)
    beta, ridge = np.array([-2.0, 0.5, 0.0]), np.diag([1e-3, 0.5, 0.5])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), matched clauses.

    Null and empty texts have no clause and get the lowest score. Repeated rows each get their row; null ids stay; other
    columns are not read. The grammar is bounded by MAX_STEMS.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow = pa.schema([(id_col, to_arrow_type(kind)), ("score", pa.float64()), ("n_clauses", pa.int32())])

    def run(piece: pa.RecordBatch) -> list:
        found = [grammar.clauses(t) for t in piece.column(1).to_pylist()]
        return [piece.column(0).to_pylist(), [grammar.score(w) for w in found], [len(w) for w in found]]

    return map_slices(docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text")), run,
                      f"`{id_col}` {kind.simpleString()}, score double, n_clauses int", arrow)


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Documents (all their columns) that score below the threshold."""
    return keep_rows(docs, text_col, lambda texts: [grammar.score(grammar.clauses(t)) < threshold for t in texts])
