"""A quality classifier without labels: overlapping heuristics vote, EM weighs them, a hashed linear scorer learns the result."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut
from .tokens import remembered, slices, split_words

#: Weights of the scorer; features are hashed into so many places.
PLACES = 1 << 18
#: Documents that the scorer is trained on, expected; drawn by a hash of doc_id, where there are votes of an
#: annotator, at most three quarters of them from documents with one, and a quarter from the others. All documents are labelled and scored.
TRAIN_ROWS = 4_000

#: Longer slices, as making the table of distinct words is what costs most and grows less than the words.
SLICES = 4

# Words of abuse in English, German, French and Spanish, by kind. Each kind is one labeller.
ABUSE = {
    "mind": (
        "idiot idiots idiotic moron morons moronic stupid stupidity dumb imbecile fool fools dimwit halfwit brainless retarded simpleton "
        "idioten idiotisch dumm dumme dummer dummkopf trottel depp deppen blöd blöde schwachkopf hohlkopf vollidiot "
        "imbécile imbéciles crétin crétins stupide stupides débile débiles abruti abrutis "
        "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos tonto tonta tontos tarado"
    ),
    "worth": (
        "worthless pathetic loser losers useless failure failures nobody hopeless pitiful "
        "wertlos wertlose nutzlos nutzlose versager erbärmlich erbärmliche nichtsnutz taugenichts "
        "nulle minable minables inutile inutiles raté ratés pitoyable lamentable "
        "inútil inútiles perdedor perdedores patético patética fracasado fracasados miserable despreciable"
    ),
    "filth": (
        "trash scum garbage filth vermin disgusting disgust repulsive "
        "abschaum dreck dreckig müll ungeziefer ekelhaft ekelhafte widerlich widerliche gesindel "
        "ordure ordures déchet déchets vermine dégoûtant dégoûtante répugnant crasse "
        "basura escoria asqueroso asquerosa repugnante inmundicia alimaña"
    ),
    "mock": (
        "clown clowns jerk creep freak liar coward bastard bitch whore slut "
        "lügner feigling mistkerl arschloch schlampe hure spinner witzfigur "
        "menteur menteurs lâche lâches salaud salope connard bouffon "
        "payaso payasos mentiroso mentirosa cobarde cobardes bastardo puta cabrón"
    ),
}
ABUSE = {kind: words.split() for kind, words in ABUSE.items()}
QUALITY_LABELLERS = ("annotator", "symbols", "capitals", "shouting", "repeats", "length", "endings", "variety", "tables", "plain")
TOXIC_LABELLERS = ("annotator", *ABUSE, "several", "dense", "none")
_LEXICON = {w: i for i, words in enumerate(ABUSE.values()) for w in words}
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_KINDS = 8  # symbols, all capitals, shouting, table bar, then one for each kind of abuse


#: Lengths of the word beginnings that are features, as languages build words of abuse from stems.
STEMS = (4, 5, 6, 7)


def _place(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}") % PLACES


_SPLIT = re.compile(r"(.)\1+")
#: What a worker remembers of words, for the labellers and for the scorer.
_MARKED: dict[str, tuple] = {}
_SEEN: dict[str, tuple] = {}


def _bare(raw: str) -> str:
    return raw.lower() if raw.isalpha() else " ".join(_WORD.findall(raw)).lower()


def _marks(raw: str) -> tuple[int, int]:
    """What the labellers need of one distinct word: kinds as bits, and a hash."""
    kinds = 2 if len(raw) > 1 and raw.isupper() else 0
    if not raw.isalpha():
        kinds |= (1 if any(c in raw for c in "#*$%&|<>") else 0) | (4 if raw.endswith("!!") else 0) | (8 if raw == "|" else 0)
    bare = _bare(raw)
    for b in (bare,) if " " not in bare else bare.split():
        if b in _LEXICON:
            kinds |= 1 << (4 + _LEXICON[b])
    return kinds, xxhash.xxh64_intdigest(raw.lower())


def _word(raw: str) -> tuple[tuple[int, ...], int]:
    """What the scorer needs of one distinct word: hashed features of the word and its stems, and of its shape."""
    if raw.isalpha():
        shape = "a" if raw.islower() else "A" if raw.isupper() else "Aa" if raw[1:].islower() else "AaA"
    else:
        shape = _SPLIT.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in raw))
    bare = _bare(raw)
    word = _place("w", bare)
    return (word, *[_place("p", bare[:n]) if len(bare) >= n else word for n in STEMS]), _place("s", shape)


@dataclass
class _Slice:
    """The words of some texts: of each distinct word what was made of it, in columns; each word's code and text; texts' sizes."""

    made: list[np.ndarray]
    codes: np.ndarray
    owner: np.ndarray
    size: np.ndarray

    def distinct(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (text, value) pairs of values below 2**32, one a word, as two arrays in order of the text."""
        pairs = np.unique(self.owner * (1 << 32) + values)
        return pairs >> 32, pairs & ((1 << 32) - 1)


def _read(texts: pa.Array, memory: dict, make: Callable[[str], tuple], empty: Sequence[np.ndarray]) -> _Slice:
    words, offsets = split_words(texts, lower=False)
    table = remembered(words, memory, make)
    codes, size = words.indices.to_numpy().astype(np.int64), np.diff(offsets).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    if not table:
        none = np.empty(0, np.int64)
        return _Slice(list(empty), none, none, np.zeros(len(texts), np.int64))
    made = [np.array(c, e.dtype) for c, e in zip(zip(*table, strict=True), empty, strict=True)]
    real = pc.not_equal(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False)[codes]
    return _Slice(made, codes[real], owner[real], np.bincount(owner[real], minlength=len(texts)))


def _read_marks(texts: pa.Array) -> _Slice:
    """Kinds and hash of each distinct word."""
    return _read(texts, _MARKED, _marks, (np.empty(0, np.int64), np.empty(0, np.uint64)))


def _read_features(texts: pa.Array) -> _Slice:
    """Features and shape of each distinct word."""
    return _read(texts, _SEEN, _word, (np.empty((0, 1 + len(STEMS)), np.int64), np.empty(0, np.int64)))


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of all labellers but the annotator for each text: 1 good or toxic, -1 bad or clean, 0 no opinion."""
    for batch in slices(batches, times=SLICES):
        x, rows = _read_marks(batch.column("text")), batch.num_rows
        word_kinds, word_hashes = x.made
        per = lambda owner: np.bincount(owner, minlength=rows)
        n = np.maximum(x.size, 1)
        kinds = word_kinds[x.codes]
        share = [per(x.owner[(kinds >> i) & 1 == 1]) / n for i in range(4)]
        hits = np.array([per(x.owner[(kinds >> i) & 1 == 1]) for i in range(4, _KINDS)])
        # four words in a row that occur before in the same text
        h, own = word_hashes[x.codes], x.owner
        four = h[:-3] * np.uint64(3) + h[1:-2] * np.uint64(5) + h[2:-1] * np.uint64(7) + h[3:] * np.uint64(11) if len(h) > 3 else h[:0]
        whole = own[:-3] == own[3:] if len(h) > 3 else np.empty(0, bool)
        of = own[: len(four)][whole]
        _, first = np.unique(four[whole] ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        again = 1 - per(of[first]) / np.maximum(per(of), 1)
        start = np.cumsum(x.size) - x.size
        # distinct words in each 200 words, whole text; the share's mean by words
        before = np.cumsum(-(-x.size // 200)) - -(-x.size // 200)
        spans, of_span = before[own] + (np.arange(len(own)) - start[own]) // 200, np.zeros((-(-x.size // 200)).sum() + 1, np.int64)
        of_span[spans] = own
        variety = per(of_span[np.unique(spans * (1 << 32) + x.codes) >> 32]) / n
        lines = pc.split_pattern(pc.fill_null(batch.column("text"), "").cast(pa.large_string()), "\n")
        line = pc.utf8_trim_whitespace(lines.flatten())
        of_line = np.repeat(np.arange(rows), np.diff(lines.offsets.to_numpy()))
        filled = pc.not_equal(line, "").to_numpy(zero_copy_only=False)
        unended = filled & ~pc.match_substring_regex(line, r"[.!?\":)]$").to_numpy(zero_copy_only=False)
        loose = per(of_line[unended]) / np.maximum(per(of_line[filled]), 1)
        # a labeller of one defect has no opinion of documents without it
        found = [(share[0], 0.3), (share[1], 0.5), (share[2], 0.3), (again, 0.3), ((x.size < 3).astype(float), 1), (loose, 0.9), (1 - variety, 0.8), (share[3], 0.2)]
        plain = (share[3] <= 0.05) & (x.size >= 3)
        for value, limit in found[:4]:
            plain &= value <= limit / 3
        quality = np.stack([*[np.where(value >= limit, -1, 0) for value, limit in found], plain.astype(int)], axis=1)
        several = hits.sum(axis=0)
        toxic = np.stack([*(hits > 0).astype(int), (several > 1).astype(int), (several > 0.005 * n).astype(int), -(several == 0).astype(int)], axis=1)
        longs = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(quality.tolist(), longs), pa.array(toxic.tolist(), longs)], names=["doc_id", "quality", "toxic"])


#: Posteriors that EM starts from, by the annotator's vote, or else the sign of the votes' sum.
START = {1: 0.97, 0: 0.5, -1: 0.03}
#: The share of wrong votes that an annotator is first believed to have.
ANNOTATOR_ERROR = 0.005


@dataclass
class LabelModel:
    """Of each labeller, how likely its votes (-1, 0, 1) are on true and on false documents; the share of true ones; each pattern's posterior."""

    on_true: list[dict[int, float]]
    on_false: list[dict[int, float]]
    prior: float
    posterior: dict[tuple[int, ...], float]


def fit_label_model(counts: dict[tuple[int, ...], int], rounds: int = 50, smooth: float = 2.0, trust: float = 0.5) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, labellers taken as independent given the truth.

    The first labeller is the annotator. EM starts from its votes, where it has any, and from the sign of the
    votes' sum elsewhere, which settles which class is which. A vote of no opinion says nothing; labellers of
    their own speak for documents without any finding. What documents the annotator has read is left out of
    its accuracies, which are those of its votes; as nothing else may speak where it does, and then nothing
    in the votes tells whether it errs, they are drawn by trust towards an error of ANNOTATOR_ERROR. smooth
    pseudo-votes spread over the three votes keep the others' likelihoods above 0.
    """
    n, total = len(next(iter(counts), ())), sum(counts.values())
    post = {v: START[v[0] or max(-1, min(1, sum(v)))] for v in counts}
    prior, on_true, on_false = 0.5, [], []
    for _ in range(rounds if counts else 0):
        prior = (sum(c * post[v] for v, c in counts.items()) + 1) / (total + 2)
        yes, no = prior * total, (1 - prior) * total

        def votes_of(i: int, side, size: float) -> dict[int, float]:
            return {x: (sum(c * side(post[v]) for v, c in counts.items() if v[i] == x) + smooth / 3) / (size + smooth) for x in (-1, 0, 1)}

        def votes_of_annotator(side, right: int) -> dict[int, float]:
            held = {x: sum(c * side(post[v]) for v, c in counts.items() if v[0] == x) for x in (-1, 1)}
            believed = {right: 1 - ANNOTATOR_ERROR, -right: ANNOTATOR_ERROR}
            seen = sum(held.values())
            return {x: believed[x] * trust + (1 - trust) * held[x] / seen if seen else believed[x] for x in held}

        on_true = [votes_of_annotator(lambda p: p, 1), *(votes_of(i, lambda p: p, yes) for i in range(1, n))]
        on_false = [votes_of_annotator(lambda p: 1 - p, -1), *(votes_of(i, lambda p: 1 - p, no) for i in range(1, n))]
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[x] / f[x]) for x, t, f in zip(v, on_true, on_false, strict=True) if x)
            post[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return LabelModel(on_true, on_false, prior, post)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed features of each text, packed as 32-bit numbers: those of its distinct words, and its distinct shapes."""
    for batch in slices(batches, times=SLICES):
        x = _read_features(batch.column("text"))
        features, shapes = x.made
        owner, code = x.distinct(x.codes)
        by_shape, shape = x.distinct(shapes[x.codes])
        ends, shape_ends = (np.searchsorted(o, np.arange(batch.num_rows + 1)) for o in (owner, by_shape))
        rows = [np.concatenate([features[code[ends[i] : ends[i + 1]]].ravel(), shape[shape_ends[i] : shape_ends[i + 1]]]).astype(np.int32).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "places"])


def weigh(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Weights of training rows: 1, but for rows without the annotator's vote on which no labeller found anything.

    Those teach that whatever the labellers cannot see is fine; together they weigh a third of the annotator's rows, or
    as much as the rows with a finding, if that is more.
    """
    silent = ~known & ~found
    most = max(known.sum() / 3, (~known & found).sum(), 1.0)
    return np.where(silent, min(1.0, most / max(silent.sum(), 1)), 1.0)


def train_scorer(rows: Sequence[np.ndarray], targets: np.ndarray, weights: np.ndarray, rounds: int = 80, rate: float = 0.05, sparse: float = 2e-4, batch: int = 128, seed: int = 5) -> np.ndarray:
    """A scorer over hashed places, the bias last: logistic regression on soft, weighted targets by AdaGrad with an L1 step, which leaves noise at 0."""
    w, seen = np.zeros(PLACES + 1), np.full(PLACES + 1, 1e-8)
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = np.array([len(rows[i]) + 1 for i in own])
            places = np.concatenate([part for i in own for part in (rows[i], [PLACES])]).astype(np.int64)
            z = np.add.reduceat(w[places], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            miss = (targets[own] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * weights[own]
            slope = np.bincount(places, np.repeat(miss, sizes) / len(own), len(w))
            seen += slope**2
            step = rate / np.sqrt(seen)
            w += step * slope
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * sparse, 0) * (seen[:-1] > 1e-7)
    return w


def score(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """doc_id, quality, toxic (probabilities) and kept of every row of docs.

    Labellers vote on every document. labels (doc_id, quality, toxic as 0 or 1), if given, is one more
    labeller, the annotator, that votes on the documents it has; of several labels of one document the
    greater counts. The counts of vote patterns, whose number the labellers bound, reach the driver for EM,
    which estimates every labeller's accuracies, the annotator's too, and gives each pattern a posterior. About
    train_rows documents, drawn by a hash of doc_id (at most three quarters from the annotator's, if there are any, and a quarter from the others), train
    one hashed linear scorer for quality and one for toxicity with their posteriors as targets. Of rows that
    share a doc_id one is trained on. The scorers then score every document. kept: quality is at
    least least_quality and toxic at most most_toxic. A null or empty text has no features and takes the
    bias' score; repeated rows score alike; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    votes = docs.mapInArrow(_label, "doc_id long, quality array<int>, toxic array<int>")
    none = F.lit(0)
    if labels is None:
        votes = votes.withColumn("by_quality", none).withColumn("by_toxic", none)
    else:
        sign = lambda c: F.when(c > 0, 1).when(c == 0, -1).otherwise(0)
        given = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(sign(F.max("quality")).alias("by_quality"), sign(F.max("toxic")).alias("by_toxic"))
        votes = votes.join(given, "doc_id", "left").withColumn("by_quality", F.coalesce("by_quality", none)).withColumn("by_toxic", F.coalesce("by_toxic", none))
    voted = cut(votes.select("doc_id", *[F.concat(F.array(f"by_{n}"), n).alias(n) for n in ("quality", "toxic")]))
    models = {}
    for name in ("quality", "toxic"):
        models[name] = fit_label_model({tuple(r[0]): r[1] for r in voted.groupBy(name).count().collect()})

    def posterior(name: str) -> F.Column:
        pairs = [x for v, p in sorted(models[name].posterior.items()) for x in (F.lit(",".join(map(str, v))), F.lit(float(p)))]
        return F.element_at(F.create_map(*pairs), F.array_join(name, ",")) if pairs else F.lit(0.5)

    known = F.lit(False) if labels is None else (F.element_at("quality", 1) != 0) | (F.element_at("toxic", 1) != 0)
    # 1 where some labeller found a defect, or abuse
    finding = {"quality": F.exists(F.slice("quality", 2, 99), lambda v: v < 0), "toxic": F.exists(F.slice("toxic", 2, 99), lambda v: v > 0)}
    of = lambda n: F.struct(posterior(n).alias("target"), (F.element_at(n, 1) != 0).alias("known"), finding[n].alias("found")).alias(n)
    pool = voted.select("doc_id", known.alias("known"), of("quality"), of("toxic"))
    n, n_known = pool.agg(F.count_distinct("doc_id"), F.count_distinct(F.when(F.col("known"), F.col("doc_id")))).first()
    of_known = min(train_rows * 3 // 4, n_known)
    share = lambda k, of: F.lit(int((1 << 30) * min(1.0, k / max(of, 1))))
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30))
    taken = draw < F.when(F.col("known"), share(of_known, n_known)).otherwise(share(train_rows // 4 if n_known else train_rows, n - n_known))
    drawn = cut(pool.where(taken).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")))
    chosen = docs.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")  # about train_rows ids
    featured = chosen.mapInArrow(_featured, "doc_id long, places binary").groupBy("doc_id").agg(F.max("places").alias("places"))
    sample = featured.join(drawn, "doc_id").orderBy("doc_id").collect()
    rows = [np.frombuffer(r["places"], np.int32) for r in sample]
    weights = {n: np.zeros(PLACES + 1) for n in models}
    for name in models if rows else ():
        targets, known_rows, found_rows = (np.array([r[name][c] for r in sample]) for c in ("target", "known", "found"))
        weights[name] = train_scorer(rows, targets, weigh(known_rows, found_rows))
    packed = {n: w for n, w in weights.items()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, times=SLICES):
            x = _read_features(batch.column("text"))
            features, shapes = x.made
            owner, code = x.distinct(x.codes)
            by_shape, shape = x.distinct(shapes[x.codes])
            out = []
            for w in (packed["quality"], packed["toxic"]):
                z = np.bincount(owner, w[features].sum(axis=1)[code], batch.num_rows) + np.bincount(by_shape, w[shape], batch.num_rows) + w[PLACES]
                out.append(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], names=["doc_id", "quality", "toxic"])

    out = docs.mapInArrow(scored, "doc_id long, quality double, toxic double")
    return out.withColumn("kept", (F.col("quality") >= least_quality) & (F.col("toxic") <= most_toxic))
