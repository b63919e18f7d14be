"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Labelled examples of each class that are learned from, at most; they, their terms and the index are bounded by it.
EXAMPLES = 4096
#: What makes a term telling: its association with the label (chi-squared, one degree) and the documents that hold it.
MIN_CHI2, MIN_DOCS = 30.0, 5
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 25, 64, 8
#: Blocks are left out if of so many examples' searches the share of blocks read late is below this; results are the same.
TRIED, WORTH = 64, 0.75
#: Beside whole words, their beginnings of these lengths are terms: they find what inflected words share.
PREFIXES = (4, 5, 6, 7)
SEED = 7
_WORDS = regex.compile(r"\w+").findall


def terms_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept from learning: crc32 of the id as text, modulo 5, is 0. A null id's are learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def draw_examples(labels: DataFrame, label: str = "toxic", bound: int = EXAMPLES) -> tuple[list[tuple[int, int]], dict[int, float]]:
    """(doc_id, label) of at most bound learnable rows a class, and what one of a class stands for.

    Rows go by a hash of their id; a threshold on it thins large classes before they are sorted, so what
    reaches the driver doesn't grow with the table. A document that is labelled twice counts by its larger label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    drawn: list[tuple[int, int]] = []
    for y, n in sorted(sizes.items()):
        near = known.where((F.col("y") == y) & (place <= min(1.0, 1.5 * bound / n) * (1 << 30)))
        drawn += [(r["doc_id"], y) for r in near.orderBy(place, "doc_id").limit(bound).select("doc_id").collect()]
    taken = Counter(y for _, y in drawn)
    return drawn, {y: sizes[y] / taken[y] for y in taken}


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) to (term, with label 1, with label 0) over a task's examples."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = set(_WORDS((text.as_py() or "").lower()))
            seen[y].update({t for w in words for t in terms_of(w)})
    every = list(seen[0].keys() | seen[1].keys())
    for i in range(0, len(every), 50_000):
        part = every[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[1][t] for t in part]), pa.array([seen[0][t] for t in part])], ["term", "a", "b"])


def choose_terms(texts: DataFrame, n1: int, n0: int) -> list[str]:
    """The terms that the examples of label 1 hold more often, by chi-squared; as many as the bounded examples have."""
    counts = texts.select("text", "y").mapInArrow(_example_terms, "term string, a long, b long").groupBy("term").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), n1 + n0
    chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n - a - b) * n1 * n0)
    told = counts.where((a + b >= MIN_DOCS) & (a + b < n) & (a * n0 > b * n1)).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2)
    return sorted(r["term"] for r in told.select("term").collect())


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to the distinct words of a task's examples."""
    words: set[str] = set()
    for batch in batches:
        for text in batch.column(0):
            words.update(_WORDS((text.as_py() or "").lower()))
    yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["word"])


#: Each example's terms and how often it has them.
Vectors = Sequence[tuple[Sequence[int] | np.ndarray, Sequence[int] | np.ndarray]]
COUNTS = "doc_id long, ids array<int>, tfs array<int>, word_ids array<int>, word_tfs array<int>"


def _count_terms(terms: list[str], words: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to how often a document has each telling term and each word of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: i for i, t in enumerate(terms)}
        word_at = {w: i for i, w in enumerate(words)}
        of_word: dict[str, list[int]] = {}
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in batch.column(1):
                held: Counter = Counter()
                whole: list[tuple[int, int]] = []
                for w, n in Counter(_WORDS((text.as_py() or "").lower())).items():
                    i = word_at.get(w)
                    if i is not None:
                        whole.append((i, n))
                    own = of_word.get(w)
                    if own is None:
                        if len(of_word) > 100_000:
                            of_word.clear()
                        own = of_word[w] = [at[t] for t in terms_of(w) if t in at]
                    for i in own:
                        held[i] += n
                for found, ids, tfs in ((sorted(held.items()), columns[0], columns[1]), (sorted(whole), columns[2], columns[3])):
                    ids.append([i for i, _ in found])
                    tfs.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], ["doc_id", "ids", "tfs", "word_ids", "word_tfs"])

    return run


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges one after another, and which range each is of."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + (starts - (np.cumsum(sizes) - sizes))[of], of


class BlockMaxIndex:
    """Inverted lists of unit TF-IDF vectors in blocks of examples, with the largest weight of each term in each block.

    search() is exact, one way or the other: a block is left out only if the sum of its largest weights can't reach the k-th best.
    """

    def __init__(self, vectors: Vectors, labels: list[int], doc_ids: list[int], idf: np.ndarray, stands_for: dict[int, float]):
        self.idf, self.n = idf, len(vectors)
        self.labels, self.doc_ids = np.array(labels, np.int64), np.array(doc_ids, np.int64)
        self.stands_for = np.array([stands_for[y] for y in labels], np.float64)
        self.blocks = max(1, -(-self.n // BLOCK))
        none = np.zeros(0)
        terms = np.concatenate([none.astype(np.int32), *(np.asarray(ids, np.int32) for ids, _ in vectors)])
        who = np.repeat(np.arange(self.n, dtype=np.int32), [len(ids) for ids, _ in vectors]) if self.n else none.astype(np.int32)
        order = np.argsort(terms, kind="stable")
        terms, self.who = terms[order], who[order]
        every = np.arange(len(idf) + 1, dtype=np.int32)
        self.lists = np.searchsorted(terms, every)
        self.weight = np.concatenate([none, *(self.weights(ids, tfs) for ids, tfs in vectors)])[order]
        # A run of one term's postings in one block; runs of a term follow one another.
        block = self.who // BLOCK
        self.runs = np.flatnonzero(np.diff(terms * np.int64(self.blocks) + block, prepend=-1))
        self.block, self.run_ends = block[self.runs], np.append(self.runs[1:], len(terms)).astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, self.runs) if len(terms) else none
        self.starts = np.searchsorted(terms[self.runs], every)
        # Texts of many common words leave no block out; then whole lists are read, which is faster than their parts.
        tried = [self._by_blocks(np.array(ids, np.int64), self.weights(ids, tfs), NEIGHBOURS, -1)[2] for ids, tfs in vectors[:TRIED] if len(ids)]
        self.prunes = not tried or float(np.mean(tried)) < WORTH

    def settle(self) -> None:
        """Lets go of the blocks if none of them would be left out; whole lists are read from then on."""
        if not self.prunes:
            del self.runs, self.run_ends, self.block, self.most, self.starts

    def weights(self, ids: Sequence[int] | np.ndarray, tfs: Sequence[int] | np.ndarray) -> np.ndarray:
        w = (1 + np.log(np.array(tfs, np.float64))) * self.idf[np.array(ids, np.int64)] if len(ids) else np.zeros(0)
        return w / (np.sqrt((w * w).sum()) or 1.0)

    def search(self, ids: list[int], tfs: list[int], k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a cosine above 0 and their cosines, ties to the first."""
        at, query = np.array(ids, np.int64), self.weights(ids, tfs)
        if not len(at):
            return np.zeros(0, np.intp), np.zeros(0)
        if self.prunes:
            return self._by_blocks(at, query, k, without)[:2]
        score = self._all_cosines(at, query)
        found = self._best(score, k, without)
        return found, score[found]

    def _by_blocks(self, at: np.ndarray, by_term: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray, float]:
        """search, and the share of the blocks with a bound that had to be read after the first."""
        runs, of = _ranges(self.starts[at], self.starts[at + 1])
        query = by_term[of]
        bounds = np.bincount(self.block[runs], query * self.most[runs], self.blocks)
        # The blocks with the highest bounds first: their k-th cosine tells which others can still matter.
        first = np.zeros(self.blocks, bool)
        first[np.argpartition(-bounds, FIRST_BLOCKS)[:FIRST_BLOCKS] if self.blocks > FIRST_BLOCKS else slice(None)] = True
        score = self._cosines(runs, query, first)
        found = self._best(score, k, without)
        kth = score[found[-1]] if len(found) == k else 0.0
        more = ~first & (bounds > 0) & (bounds >= kth - 1e-12)
        if more.any():
            score += self._cosines(runs, query, more)
            found = self._best(score, k, without)
        return found, score[found], more.sum() / max(1, (bounds > 0).sum())

    def _cosines(self, runs: np.ndarray, query: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The cosines of the examples of these blocks, 0 elsewhere."""
        own = blocks[self.block[runs]]
        at, of = _ranges(self.runs[runs[own]], self.run_ends[runs[own]])
        return np.bincount(self.who[at], query[own][of] * self.weight[at], self.n)

    def _all_cosines(self, at: np.ndarray, by_term: np.ndarray) -> np.ndarray:
        parts = [(slice(a, b), q) for a, b, q in zip(self.lists[at].tolist(), self.lists[at + 1].tolist(), by_term.tolist(), strict=True)]
        return np.bincount(np.concatenate([self.who[p] for p, _ in parts]), np.concatenate([self.weight[p] * q for p, q in parts]), self.n)

    @staticmethod
    def _best(score: np.ndarray, k: int, without: int) -> np.ndarray:
        if without >= 0:
            score[without] = 0
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            kth = np.partition(score[found], -k)[-k]
            found = found[score[found] >= kth]
        return found[np.lexsort((found, -score[found]))][:k]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """The share of label 1 among the found, each by what it stands for and the inverse of its distance."""
        weight = self.stands_for[found] / (1.05 - np.minimum(cosines, 1.0))
        return float((weight * self.labels[found]).sum() / weight.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function (edges, values) nearest to y by w, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        if pools and pools[-1][0] == x[i]:
            total = pools[-1][2] + w[i]
            pools[-1][1:] = [(pools[-1][1] * pools[-1][2] + y[i] * w[i]) / total, total]
        else:
            pools.append([float(x[i]), float(y[i]), float(w[i])])
    merged: list[list[float]] = []
    for pool in pools:
        merged.append(pool)
        while len(merged) > 1 and merged[-2][1] >= merged[-1][1]:
            _, v, n = merged.pop()
            total = merged[-1][2] + n
            merged[-1][1:] = [(merged[-1][1] * merged[-1][2] + v * n) / total, total]
    return np.array([m[0] for m in merged]), np.array([m[1] for m in merged])


class Calibrated:
    """An index with the share of label 1 that a vote of it means, fitted on the examples `own` alone."""

    def __init__(self, index: BlockMaxIndex, vectors: Vectors, own: list[int]):
        self.index = index
        index.settle()
        votes = [self._raw(*vectors[i], i) for i in own]
        known = np.array([v is not None for v in votes], bool)
        y, w = index.labels[own].astype(float), index.stands_for[own]
        self.none = float((y[~known] * w[~known]).sum() / w[~known].sum()) if (~known).any() else 0.0
        self.edges, self.values = isotonic(np.array([v for v in votes if v is not None]), y[known], w[known]) if known.any() else (np.zeros(0), np.zeros(0))

    def _raw(self, ids: list[int], tfs: list[int], without: int = -1) -> float | None:
        found, cosines = self.index.search(ids, tfs, without=without)
        return self.index.vote(found, cosines) if len(found) else None

    def score(self, ids: list[int], tfs: list[int]) -> tuple[float, list[dict]]:
        found, cosines = self.index.search(ids, tfs)
        evidence = [{"doc_id": int(self.index.doc_ids[i]), "label": int(self.index.labels[i]), "cosine": float(min(c, 1.0))} for i, c in zip(found[:5], cosines[:5], strict=True)]
        if not len(found) or not len(self.edges):
            return self.none, evidence
        at = int(np.searchsorted(self.edges, self.index.vote(found, cosines), "right")) - 1
        return float(self.values[max(at, 0)]), evidence


class Model:
    """Two indexes of the same examples: of their telling terms, and of all their words for texts without any of those."""

    def __init__(self, told: Vectors, whole: Vectors, labels: list[int], doc_ids: list[int], idf: np.ndarray, word_idf: np.ndarray, stands_for: dict[int, float]):
        every = range(len(labels))
        self.told = Calibrated(BlockMaxIndex(told, labels, doc_ids, idf, stands_for), told, [i for i in every if len(told[i][0])])
        self.whole = Calibrated(BlockMaxIndex(whole, labels, doc_ids, word_idf, stands_for), whole, [i for i in every if not len(told[i][0])])

    def score(self, ids: list[int], tfs: list[int], word_ids: list[int], word_tfs: list[int]) -> tuple[float, list[dict]]:
        return self.told.score(ids, tfs) if len(ids) else self.whole.score(word_ids, word_tfs)


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    evidence_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, list[dict]]] = {}
        for batch in batches:
            scores, evidence = [], []
            for row in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                own = [x.values.to_numpy() for x in row]
                key = hashlib.blake2b(b"|".join(x.tobytes() for x in (own[:2] if len(own[0]) else own[2:])), digest_size=16, person=b"told" if len(own[0]) else b"whole").digest()
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = model.score(*own)
                scores.append(known[key][0])
                evidence.append(known[key][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, evidence_type)], ["doc_id", "score", "evidence"])

    return run


def _idf(counts: DataFrame, ids: str, size: int, n: int) -> np.ndarray:
    """By the documents of all that have each term; a row a term reaches the driver, in Arrow."""
    df = np.zeros(size)
    found = counts.select(F.explode(ids).alias("i")).groupBy("i").agg(F.count("*").alias("n")).toArrow()
    df[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return np.log((n + 1) / (df + 1)) + 1


def _vectors(seen: pa.Table, ids: str, tfs: str) -> Vectors:
    """Two columns of lists as views of their flat values, without an object for each number."""
    at, n = (seen.column(c).combine_chunks() for c in (ids, tfs))
    ends, terms, counts = at.offsets.to_numpy(), at.values.to_numpy(), n.values.to_numpy()
    shift = n.offsets.to_numpy() - ends
    return [(terms[a:b], counts[a + c : b + c]) for a, b, c in zip(ends[:-1].tolist(), ends[1:].tolist(), shift.tolist(), strict=False)]


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the five nearest examples: doc_id, label, cosine) of every row.

    Learned from at most EXAMPLES rows a class whose ids aren't held out; of an id with several texts the
    least counts. A text with terms that go with label 1 is searched among the examples by the TF-IDF of those
    terms, any other by the TF-IDF of all words that the examples have; document frequencies are of all docs. The
    vote of the 25 nearest becomes a probability by isotonic regression on the examples that are searched the same
    way, each without itself. Texts without a word of the examples, null and empty ones too, get the share of label 1
    among such examples. Without a label of either class, every score is 0 or such a share.
    """
    spark = docs.sparkSession
    drawn, stands_for = draw_examples(labels, label)
    sample = spark.createDataFrame(drawn, "doc_id long, y int")  # two classes of EXAMPLES rows at most, so safe to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))
    texts = written(texts, "examples")
    n1, n0 = (sum(y == k for _, y in drawn) for k in (1, 0))
    terms = choose_terms(texts, n1, n0) if n1 and n0 else []
    words = sorted(texts.select("text").mapInArrow(_example_words, "word string").distinct().toArrow().column("word").to_pylist()) if n1 and n0 else []
    counts = written(docs.select("doc_id", "text").mapInArrow(_count_terms(terms, words), COUNTS), "toxicity")
    n = counts.count()
    seen = texts.select("doc_id", "text").mapInArrow(_count_terms(terms, words), COUNTS).join(F.broadcast(sample), "doc_id").orderBy("doc_id").toArrow()  # a row an example
    told, whole = _vectors(seen, "ids", "tfs"), _vectors(seen, "word_ids", "word_tfs")
    model = Model(told, whole, seen.column("y").to_pylist(), seen.column("doc_id").to_pylist(), _idf(counts, "ids", len(terms), n), _idf(counts, "word_ids", len(words), n), stands_for)
    scored = counts.mapInArrow(_score(model), "doc_id long, score double, evidence array<struct<doc_id:long,label:int,cosine:double>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op6_labelled_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_toxicity of all documents by the toxic labels, with the nearest examples as evidence."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
