"""Toxicity of texts: a lexicon matched with edits, judged in the context of each match.

Learning (``fit``) reads a bounded sample of labelled rows.  Beginnings of words and whole words that
toxic documents use far more often become a lexicon of words and stems.  Its trie is intersected
with Levenshtein automata (``automaton``), which finds misspelled terms too; spellings that
clean documents of the sample use themselves are no misspellings.  Each match is then weighted by its window: the words
around it, and whether it stands between quotation marks, each as often as they go with
matches in toxic and in clean documents, so quoting a term counts less than using it.  A
logistic rule over sums of these weights gives the score.

Scoring is one pass over the texts without a shuffle.  The model is bounded by
``FIT_ROWS``, ``LEXICON`` and ``CONTEXT``, whatever the size of the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.automaton import Lexicon
from kontor.session import checkpoint_cut

#: Labelled rows that are learned from: those with the lowest hashed ids.
FIT_ROWS = 12_000
#: Entries of the lexicon, and candidates that they are chosen from.
LEXICON, CANDIDATES = 256, 4096
#: Words whose presence in a window has a weight.
CONTEXT = 2048
#: Letters of a stem.
STEM = range(3, 11)
#: A word counts so often in one document at most while the lexicon is chosen.
REPEATS = 5
#: Documents that an entry has to be in.
SUPPORT = 3
#: Words before and after a match.
WINDOW = 5
#: Matches' worth of prior belief in a weight.
PRIOR = 4.0
#: Share of an entry's weight that an unseen misspelling has before anything is learned.
MISSPELLED = 0.5

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
QUOTES = re.compile("[\"“”„«»‹›]")

FEATURES = ("weight", "density", "highest", "kinds", "exact", "misspelled", "quoted", "length")


@dataclass
class Model:
    """What scoring needs: lexicon entries with weights, window weights, the logistic rule."""

    entries: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    misspelled: list[float] = field(default_factory=list)
    harmless: set[str] = field(default_factory=set)
    context: dict[str, float] = field(default_factory=dict)
    quoted: float = 0.0
    centre: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    rule: list[float] = field(default_factory=lambda: [0.0] * (1 + len(FEATURES)))


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is divisible by 5, or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learnable(labels: DataFrame, id_col="doc_id", label_col="toxic") -> DataFrame:
    """One label a document (the highest) of those that may be learned from, ``FIT_ROWS`` at most."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col))
    one = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)


def matches(text: str | None, lexicon: Lexicon, harmless: set[str]) -> tuple[list[str], list[tuple[int, int, int, bool]]]:
    """The words, and (place, entry, edits, whether it stands in quotation marks) of each match."""
    low = (text or "").lower()
    words = TOKEN.findall(low)
    found = [(i, hit) for i, hit in enumerate(map(lexicon.__getitem__, words)) if hit is not None]
    found = [(i, e, k) for i, (e, k) in found if not k or words[i] not in harmless]
    if not found or not QUOTES.search(low):
        return words, [(i, e, k, False) for i, e, k in found]
    # a match is quoted if an odd number of marks stands before it in its line, and one after it
    starts = [m.start() for m in TOKEN.finditer(low)]
    marks, lines = [m.start() for m in QUOTES.finditer(low)], [m.start() for m in re.finditer("\n", low)]
    at = [starts[i] for i, _, _ in found]
    line = np.searchsorted(lines, at)
    first = np.array([-1, *lines])[line]
    last = np.array([*lines, len(low)])[line]
    before = np.searchsorted(marks, at) - np.searchsorted(marks, first)
    after = np.searchsorted(marks, last) - np.searchsorted(marks, at)
    return words, [(i, e, k, bool(b % 2 and a)) for (i, e, k), b, a in zip(found, before, after)]


def window(words: list[str], place: int) -> set[str]:
    return {*words[max(0, place - WINDOW) : place], *words[place + 1 : place + 1 + WINDOW]}


def features(text: str | None, lexicon: Lexicon, model: Model) -> tuple[list[float], int]:
    """The sums that the rule reads, and the number of matches."""
    words, found = matches(text, lexicon, model.harmless)
    total = highest = 0.0
    exact = edited = quoted = 0
    for place, entry, edits, inside in found:
        near = [model.context[w] for w in window(words, place) if w in model.context]
        weight = (model.misspelled if edits else model.weights)[entry] + (sum(near) / len(near) if near else 0.0) + (model.quoted if inside else 0.0)
        total += max(weight, 0.0)
        highest = max(highest, weight)
        edited += edits > 0
        exact += not edits
        quoted += inside
    n = len(words)
    values = [
        math.log1p(total), math.log1p(100 * total / n) if n else 0.0, highest, math.log1p(len({e for _, e, _, _ in found})),
        math.log1p(exact), math.log1p(edited), quoted / len(found) if found else 0.0, math.log1p(n),
    ]
    return values, len(found)


def _log_odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def _gain(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """Log-likelihood ratio of a two by two table."""
    def part(seen: float, rows: float, columns: float) -> float:
        return seen * math.log(seen * (all_toxic + all_clean) / (rows * columns)) if seen > 0 else 0.0

    with_, without = toxic + clean, all_toxic + all_clean - toxic - clean
    return 2 * (
        part(toxic, with_, all_toxic) + part(clean, with_, all_clean)
        + part(all_toxic - toxic, without, all_toxic) + part(all_clean - clean, without, all_clean)
    )


def _nodes(train: DataFrame) -> DataFrame:
    """Documents and (bounded) uses of each beginning of a word, and of each word (ending in a blank), by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: Counter[str] = Counter()
                for word, n in Counter(TOKEN.findall((text or "").lower())).items():
                    own[word + " "] += n
                    for size in STEM:
                        if len(word) >= size:
                            own[word[:size]] += n
                for node, n in own.items():
                    row = seen[node]
                    row[1 - toxic] += 1
                    row[3 - toxic] += min(n, REPEATS)
        rows = list(seen.items())
        for at in range(0, len(rows), 100_000):
            part = rows[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"node": [k for k, _ in part], **{c: pa.array([v[i] for _, v in part], pa.int64()) for i, c in enumerate(("d1", "d0", "o1", "o0"))}})

    found = train.select("text", "toxic").mapInArrow(run, "node string, d1 long, d0 long, o1 long, o0 long")
    return found.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("d1", "d0", "o1", "o0")))


def _choose(nodes: DataFrame, toxic: int, clean: int) -> tuple[list[tuple[str, bool]], list[float]]:
    """Entries and weights: the most telling beginnings and words, none of which begins another."""
    kinds, uses1, uses0 = nodes.agg(F.count("*"), F.sum("o1"), F.sum("o0")).first()
    if not kinds or not toxic or not clean:
        return [], []
    # the likelihood ratio's larger half orders the candidates; the whole is taken of those
    more = F.col("d1") * F.log(F.col("d1") * (toxic + clean) / ((F.col("d1") + F.col("d0")) * toxic))
    likely = nodes.where((F.col("d1") >= SUPPORT) & (F.col("d1") * clean > F.col("d0") * toxic)).withColumn("more", more)
    rows = likely.orderBy(F.desc("more"), F.desc(F.length("node")), "node").limit(CANDIDATES).collect()
    # a chance find among all beginnings is as good as this
    least = 2 * math.log(100 * kinds)
    told = {r["node"]: r for r in rows}
    scored = [(_gain(r["o1"], r["o0"], uses1, uses0), r) for r in rows if _gain(r["d1"], r["d0"], toxic, clean) > least]
    scored.sort(key=lambda x: (-x[0], -len(x[1]["node"]), x[1]["node"]))
    chosen: list[tuple[str, bool]] = []
    weights: list[float] = []
    taken: set[str] = set()
    inside: set[str] = set()
    for _, r in scored:
        node, word = r["node"], r["node"].rstrip(" ")
        whole = told.get(f"{word} ")
        stem = not node.endswith(" ") and not (whole is not None and whole["o1"] >= 0.9 * r["o1"])
        begins = {word[:i] for i in range(1, len(word) + 1)}
        if word in inside or begins & taken:
            continue
        chosen.append((word, stem))
        weights.append(_log_odds(r["o1"], r["o0"], uses1, uses0))
        taken.add(word)
        inside |= begins
        if len(chosen) == LEXICON:
            break
    return chosen, weights


def _spellings(train: DataFrame, entries: list[tuple[str, bool]]) -> DataFrame:
    """Documents with each misspelling, by entry and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = Lexicon(entries), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, found = matches(text, lexicon, set())
                seen.update((e, words[i], toxic) for i, e, k in {(i, e, k) for i, e, k, _ in found} if k)
        yield pa.RecordBatch.from_pydict({
            "entry": pa.array([k[0] for k in seen], pa.int32()), "word": pa.array([k[1] for k in seen], pa.string()),
            "toxic": pa.array([k[2] for k in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64()),
        })

    found = train.select("text", "toxic").mapInArrow(run, "entry int, word string, toxic int, n long")
    return found.groupBy("entry", "word").agg(F.sum(F.col("n") * F.col("toxic")).alias("n1"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("n0"))


def _windows(train: DataFrame, model: Model) -> DataFrame:
    """Matches with each word in their window, by label; a blank stands for all, two blanks for quoted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = Lexicon(model.entries), defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, found = matches(text, lexicon, model.harmless)
                for place, _, _, inside in found:
                    for word in (*window(words, place), " ", *(["  "] if inside else [])):
                        seen[word][1 - toxic] += 1
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(list(seen), pa.string()), "n1": pa.array([v[0] for v in seen.values()], pa.int64()), "n0": pa.array([v[1] for v in seen.values()], pa.int64()),
        })

    found = train.select("text", "toxic").mapInArrow(run, "word string, n1 long, n0 long")
    return found.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    """Newton steps for a logistic rule over standardised columns."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    beta, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return centre.tolist(), scale.tolist(), beta.tolist()


def _featured(rows: DataFrame, model: Model, *kept: str) -> DataFrame:
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.entries)
        for batch in batches:
            both = [features(t.as_py(), lexicon, model) for t in batch.column(0)]
            x = np.array([v for v, _ in both]).reshape(-1, len(FEATURES))
            z = (x - np.array(model.centre)) / np.array(model.scale) @ np.array(model.rule[1:]) + model.rule[0]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(list(x), pa.list_(pa.float64())), pa.array([n for _, n in both], pa.int64()), pa.array(score)],
                names=[*kept, "features", "n_matches", "score"],
            )

    return rows.select("text", *kept).mapInArrow(run, f"{kinds}, features array<double>, n_matches long, score double")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> Model:
    """Learn from the documents that ``labels`` (doc_id, toxic 0 or 1; see ``learnable``) names.

    Repeated documents of an id count each.  Without documents of both labels the model has no entries and scores every text with the
    share of toxic ones (one half without any).  Null texts count as empty; labels without a document are left out.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # at most FIT_ROWS rows of two numbers
    train = checkpoint_cut(slim.join(F.broadcast(labels.select("doc_id", "toxic")), "doc_id").select("text", "toxic"))
    count = dict(train.groupBy("toxic").count().collect())
    toxic, clean = count.get(1, 0), count.get(0, 0)
    model = Model()
    model.rule[0] = math.log((toxic + 0.5) / (clean + 0.5))
    if not toxic or not clean:
        return model
    model.entries, model.weights = _choose(checkpoint_cut(_nodes(train)), toxic, clean)
    uses = defaultdict(lambda: [0, 0])
    for r in _spellings(train, model.entries).collect():  # misspellings of LEXICON entries in FIT_ROWS documents
        if r["n0"] * toxic >= r["n1"] * clean:
            model.harmless.add(r["word"])
        else:
            uses[r["entry"]][0] += r["n1"]
            uses[r["entry"]][1] += r["n0"]
    for i, weight in enumerate(model.weights):
        n1, n0 = uses[i]
        own = _log_odds(n1, n0, toxic, clean) if n1 + n0 else 0.0
        model.misspelled.append((PRIOR * MISSPELLED * weight + (n1 + n0) * own) / (PRIOR + n1 + n0))
    near = checkpoint_cut(_windows(train, model))
    every = near.where("word = ' '").first()
    if every is not None:
        all1, all0 = every["n1"], every["n0"]
        rate = all1 / (all1 + all0)

        def leaning(n1: int, n0: int) -> float:  # towards no weight without matches to tell
            share = (n1 + PRIOR * rate) / (n1 + n0 + PRIOR)
            return math.log(max(share, 1e-6) / max(1 - share, 1e-6)) - math.log(max(rate, 1e-6) / max(1 - rate, 1e-6)) if 0 < rate < 1 else 0.0

        many = near.where("word not in (' ', '  ') and n1 + n0 >= 5").orderBy(F.desc(F.col("n1") + F.col("n0")), "word").limit(CONTEXT)
        model.context = {r["word"]: leaning(r["n1"], r["n0"]) for r in many.collect()}
        inside = near.where("word = '  '").first()
        # before anything is seen, a quoted match is as likely a quotation as an abuse
        n1, n0 = (inside["n1"], inside["n0"]) if inside is not None else (0, 0)
        seen = (n1 + PRIOR / 2) / (n1 + n0 + PRIOR)
        model.quoted = min(0.0, math.log(seen / (1 - seen)) - math.log((all1 + 1) / (all0 + 1)))
    rows = _featured(train, model, "toxic").select("toxic", "features").collect()  # at most FIT_ROWS rows and their repeats
    rows.sort(key=lambda r: (r["features"], r["toxic"]))
    x, y = np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)
    model.centre, model.scale, model.rule = _logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id``, score (0 to 1) and n_matches (lexicon matches) of every row, from the whole text alone.

    Null and empty texts and texts without a match have the score of a text without terms.  Repeated rows and ids, and null ids, have a
    row each; ties are equal scores.  Other columns, whatever their names, aren't read.  Memory is that of one Arrow batch and the words of one text.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _featured(slim, model, "doc_id").select("doc_id", "score", "n_matches")
