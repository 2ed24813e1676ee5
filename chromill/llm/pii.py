"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier learns from their posterior."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, unused

# The base kinds' patterns. Possessive forms of the plain ones, which match the same
# spans but neither backtrack nor recurse, however long a run is.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidate kinds beyond the base: national numbers without a plus, and credentials.
ADDED = {
    "localphone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
KINDS = (*BASE, *ADDED)

# The gazetteers. What a kind's text, or the words just before it, should look like.
DOMAINS = tuple(
    "com net org edu gov mil int info biz name pro io co ai app dev me tv xyz online site shop tech blog cloud eu uk de fr es it nl be at ch "
    "se no dk fi pl cz sk hu ro bg gr pt ie is lu ru ua tr il us ca mx br ar cl pe ve cn hk tw jp kr in pk id my sg th vn ph au nz za eg ng ke ma".split()
)
ISSUERS = ("34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "60", "62", "63", "64", "65", "67", "22", "23", "24", "25", "26", "27")
SECRET_PREFIXES = (
    "sk-", "sk_", "pk_", "rk_", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "glpat-", "xox", "AKIA", "ASIA", "AIza", "ya29", "eyJ", "hf_", "npm_",
    "pypi-", "dop_v1_", "shpat_", "whsec_", "SG", "key-", "tok_",
)
CONTEXT = {
    "email": "mail|contact|write|@",
    "ip": "ip|host|server|address|from",
    "card": "card|visa|master|amex|pay|account",
    "phone": "phone|tel|call|mobile|fax|contact",
    "localphone": "phone|tel|call|mobile|fax|contact",
    "secret": "token|key|secret|passw|credential|bearer|auth",
}
#: Words before a span that speak against any kind.
AGAINST = "version|release|isbn|page|section|commit|sha|rev|uuid|checksum"
CONTEXT_CHARS = 24
#: Beyond the last place of any text.
_LAST = 2**31 - 1
LABELERS = ("pattern", "gazetteer", "context", "shape")


def _gate(kind: str) -> Column:
    """A cheap test that a text may hold the kind at all."""
    text = F.col("text")
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": text.contains("+"),
        "localphone": text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
        "secret": text.rlike(r"[A-Za-z0-9_-]{20}"),
    }[kind]


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when((F.length(digits) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, matched: Column, digits: Column) -> Column:
    """The base rule for a match of a kind, and the strict pattern's vote."""
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(matched, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "localphone":
        return n == 10
    if kind == "secret":
        return matched.rlike("[0-9]") & matched.rlike("[A-Za-z]") & ~matched.contains("--") & ~matched.contains("__")
    return F.lit(True)


def _gazetteer(kind: str, matched: Column, digits: Column) -> Column:
    vote = lambda yes: F.when(yes, 1).otherwise(-1)
    if kind == "email":
        return vote(F.lower(F.element_at(F.split(matched, r"\."), -1)).isin(*DOMAINS))
    if kind == "card":
        return vote(F.substring(digits, 1, 1).isin(*ISSUERS) | F.substring(digits, 1, 2).isin(*ISSUERS))
    if kind == "ip":
        return vote(~matched.rlike(r"^0?\.|^(?:0|[1-9])\.[0-9]\.[0-9]\.[0-9]$"))
    if kind == "secret":
        prefixed = F.lit(False)
        for p in SECRET_PREFIXES:
            prefixed = prefixed | matched.startswith(p)
        return F.when(prefixed, 1).otherwise(0)
    return vote(~F.substring(digits, 1, 1).isin("0"))


def _strict(kind: str, matched: Column, holds: Column) -> Column:
    """What the pattern labeler goes by: the base rule, and for emails and numbers the forms that are in use."""
    if kind == "email":
        return ~matched.rlike(r"\.\.|^[.%+-]|[.%+-]@|@-|-\.|\.[0-9]+$") & (F.length(matched) <= 254)
    if kind == "ip":
        return holds & ~matched.rlike(r"(?:^|\.)0[0-9]")
    return holds


def _shape(kind: str, matched: Column, digits: Column, before: Column) -> Column:
    """Length, mix of characters and what stands just before."""
    if kind == "secret":
        changes = F.length(F.regexp_replace(matched, "[0-9]+|[a-z]+|[A-Z]+", "x"))
        return F.when(changes * 4 >= F.length(matched), 1).when(F.length(matched) < 24, -1).otherwise(0)
    if kind in ("phone", "localphone"):
        return F.when(matched.rlike(r"[\x20().-]"), 1).otherwise(0)
    if kind == "ip":
        return F.when(before.rlike(r"[.0-9]$"), -1).otherwise(1)
    return F.when(before.rlike("[A-Za-z0-9]$"), -1).otherwise(1)


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of each place of an array of whole numbers above 0 what combine makes of all before it, from 0 on.

    A fold that appends copies its array each time; so blocks of about the root of the length are folded,
    each from what those before it come to, and a text of n matches takes n to the power of 1.5 copies of a number.
    values should be a column, as it is read once a block.
    """
    step = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
    zero, none = F.lit(0), F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(1), F.size(values), step), lambda at: F.slice(values, at, step))

    def within(first: Column, block: Column) -> Column:
        start = F.struct(first.alias("now"), none.alias("out"))
        return F.aggregate(block, start, lambda a, x: F.struct(combine(a.now, x).alias("now"), F.concat(a.out, F.array(a.now)).alias("out")), lambda a: a.out)

    firsts = within(zero, F.transform(blocks, lambda b: F.aggregate(b, zero, combine)))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(firsts, blocks, within))).otherwise(none)


def _most(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and spans, an array of (kind, start, stop, base, votes): each candidate with what each labeler says of it.

    start and stop count code points, stop exclusive. base tells the spans of the base rules. votes holds
    1, 0 (no opinion) or -1 in the order of LABELERS, then a bin of the length. The context of a candidate
    is what stands before it, back to the last match of its kind. Null texts have none.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    none = F.array().cast("array<string>")
    patterns = BASE | ADDED
    for kind in KINDS:
        docs = docs.withColumn(f"m_{kind}", F.when(_gate(kind), F.regexp_extract_all("text", F.lit(patterns[kind]), F.lit(0))).otherwise(none))
    docs = docs.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", patterns[k], -1)).otherwise(none).alias(f"p_{k}") for k in KINDS])
    lengths = lambda k: F.zip_with(F.slice(f"p_{k}", 1, F.size(f"m_{k}")), f"m_{k}", lambda p, m: F.length(p) + F.length(m))
    docs = docs.select("*", *[lengths(k).alias(f"n_{k}") for k in KINDS])
    docs = docs.select("doc_id", "text_key", *[F.arrays_zip(F.slice(f"p_{k}", 1, F.size(f"m_{k}")).alias("before"), F.col(f"m_{k}").alias("matched"), _running(F.col(f"n_{k}"), lambda x, y: x + y).alias("at")).alias(f"s_{k}") for k in KINDS])

    def voted(kind: str) -> Column:
        def digits(x: Column) -> Column:
            start, before = (x["at"] + F.length(x.before)).alias("start"), F.lower(F.right(x.before, F.lit(CONTEXT_CHARS))).alias("before")
            return F.struct(start, x.matched.alias("matched"), F.regexp_replace(x.matched, "[^0-9]", "").alias("digits"), before)

        def vote(x: Column) -> Column:
            holds = _holds(kind, x.matched, x.digits)
            context = F.when(x.before.rlike(CONTEXT[kind]), 1).when(x.before.rlike(AGAINST), -1).otherwise(0)
            votes = F.array(F.when(_strict(kind, x.matched, holds), 1).otherwise(-1), _gazetteer(kind, x.matched, x.digits), context, _shape(kind, x.matched, x.digits, x.before), F.least(F.length(x.matched).cast("int") / 8, F.lit(7)).cast("int"))
            return F.struct(F.lit(kind).alias("kind"), x.start.cast("long").alias("start"), (x.start + F.length(x.matched)).cast("long").alias("stop"), (holds if kind in BASE else F.lit(False)).alias("base"), votes.alias("votes"))

        return F.transform(F.transform(f"s_{kind}", digits), vote)

    return docs.select("doc_id", "text_key", F.concat(*[voted(k) for k in KINDS]).alias("spans"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[list[tuple[float, float]], dict[str, float], list[float]]:
    """Expectation-maximisation over (kind, votes, count): each labeler's chance to be right on true and on false
    candidates, each kind's share of true ones, and the posterior of each pattern."""
    n = len(LABELERS)
    right, prior = [(0.8, 0.7)] * n, {kind: 0.5 for kind, _, _ in patterns}
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for kind, votes, _ in patterns:
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for (t, f), v in zip(right, votes, strict=False):
                if v:
                    yes += math.log(t if v > 0 else 1 - t)
                    no += math.log(1 - f if v > 0 else f)
            post.append(1 / (1 + math.exp(min(700.0, no - yes))))
        for i in range(n):
            voted = [(v[i], c, p) for (_, v, c), p in zip(patterns, post, strict=True) if v[i]]
            t_all, f_all = sum(c * p for _, c, p in voted), sum(c * (1 - p) for _, c, p in voted)
            # one pseudo-count for and ten towards the first guess keep a labeler that is never wrong below certainty
            t = (sum(c * p for v, c, p in voted if v > 0) + 8) / (t_all + 10)
            f = (sum(c * (1 - p) for v, c, p in voted if v < 0) + 7) / (f_all + 10)
            right[i] = (min(max(t, 0.05), 0.99), min(max(f, 0.05), 0.99))
        for kind in prior:
            own = [(c, p) for (k, _, c), p in zip(patterns, post, strict=True) if k == kind]
            prior[kind] = min(max((sum(c * p for c, p in own) + 1) / (sum(c for c, _ in own) + 2), 0.02), 0.98)
    return right, prior, post


def _features(kind: str, votes: tuple[int, ...]) -> list[str]:
    return [f"kind:{kind}", f"length:{kind}:{votes[-1]}", *[f"{name}:{v}" for name, v in zip(LABELERS, votes, strict=False) if v]]


def train(patterns: list[tuple[str, tuple[int, ...], int]], post: list[float], rounds: int = 400, rate: float = 0.5) -> dict[str, float]:
    """Weights of a logistic span classifier, fitted to the posteriors of the patterns, each weighing its count."""
    rows = [(_features(k, v), c, p) for (k, v, c), p in zip(patterns, post, strict=True)]
    weights = {f: 0.0 for names, _, _ in rows for f in names} | {"bias": 0.0}
    total = sum(c for _, c, _ in rows) or 1
    for _ in range(rounds):
        slope = dict.fromkeys(weights, 0.0)
        for names, c, p in rows:
            z = weights["bias"] + sum(weights[f] for f in names)
            miss = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * c / total
            for f in ("bias", *names):
                slope[f] += miss
        weights = {f: w + rate * (slope[f] - 1e-4 * w) * 4 for f, w in weights.items()}
    return weights


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_key and spans, an array of (kind, start, stop, base): the base rules' spans and those the classifier adds.

    The candidates' vote patterns are counted; only those counts, of a number bounded by the labelers and
    kinds, reach the driver, for EM and the classifier. Candidates of the added kinds are kept
    if the classifier gives them threshold at least and no base span overlaps them. Spans come by kind as
    in KINDS, then by start. Null and empty texts have no spans; repeated rows get the same; an empty table
    gives no rows.
    """
    found = cut(candidates(docs))
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count()
    patterns = sorted((r[0], tuple(r[1]), r[2]) for r in seen.collect())
    _, _, post = reliabilities(patterns)
    weights = train(patterns, post) if patterns else {}
    cutoff = math.log(threshold / (1 - threshold))
    accepted = [k + "|" + ",".join(map(str, v)) for k, v, _ in patterns if k in ADDED and weights["bias"] + sum(weights[f] for f in _features(k, v)) >= cutoff]
    chosen = F.array(*[F.lit(a) for a in accepted]) if accepted else F.array().cast("array<string>")
    found = found.withColumn("chosen", chosen).select(
        "doc_id", "text_key", F.filter("spans", lambda x: x.base).alias("base_spans"),
        F.filter("spans", lambda x: x.kind.isin(*ADDED) & F.array_contains("chosen", F.concat_ws("|", x.kind, F.array_join(x.votes, ",")))).alias("more_spans"),
    )
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.stop.alias("stop"), x.base.alias("base")))
    met = (F.size("base_spans") > 0) & (F.size("more_spans") > 0)
    place = lambda x: F.struct(x.start.cast("int").alias("start"), (~x.base).alias("more"), x.stop.cast("int").alias("stop"), x.kind.alias("kind"))
    both = F.when(met, F.array_sort(F.concat(F.transform("base_spans", place), F.transform("more_spans", place)))).otherwise(F.array().cast("array<struct<start:int,more:boolean,stop:int,kind:string>>"))
    staged = found.withColumn("both", both)
    # how far the base spans before reach; and, from the end, how near to the end of the text the next one begins
    staged = staged.withColumn("reach", F.transform("both", lambda x: F.when(x.more, 0).otherwise(x.stop))).withColumn("ahead", F.reverse(F.transform("both", lambda x: F.when(x.more, 0).otherwise(F.lit(_LAST) - x.start))))
    staged = staged.withColumn("reach", _running(F.col("reach"), _most)).withColumn("ahead", F.reverse(_running(F.col("ahead"), _most)))
    free = F.filter(F.arrays_zip(F.col("both").alias("span"), F.col("reach").alias("reach"), F.col("ahead").alias("ahead")), lambda x: x.span.more & (x.reach <= x.span.start) & (F.lit(_LAST) - x.ahead >= x.span.stop))
    added = F.transform(free, lambda x: F.struct(x.span.kind.alias("kind"), x.span.start.cast("long").alias("start"), x.span.stop.cast("long").alias("stop"), F.lit(False).alias("base")))
    of = lambda kind: F.filter("added", lambda x: x.kind == F.lit(kind))
    in_order = F.concat(*map(of, ADDED))
    staged = staged.withColumn("added", F.when(met, added).otherwise(plain(F.col("more_spans"))))
    return staged.select("doc_id", "text_key", F.concat(plain(F.col("base_spans")), in_order).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")


def mask(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind in angle brackets; spans as from detect, joined on doc_id and text_key.

    Overlapping spans are masked from the left; documents without spans stay as they are, and so do columns of
    docs, whatever their names. A text of n spans takes its length times the root of n, as blocks of spans
    are cut out one after the other.
    """
    key, text_key, held = unused("mask_id", docs), unused("mask_key", docs), unused("mask_spans", docs)
    flat = spans.where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("text_key").alias(text_key), F.array_sort(F.transform("spans", lambda x: F.struct(x.start.cast("int").alias("start"), x.stop.cast("int").alias("stop"), x.kind.alias("kind")))).alias("at")).dropDuplicates([key, text_key])
    # drop what begins before an earlier span ends; what is left covers each place once
    flat = flat.withColumn("ends", F.transform("at", lambda x: x.stop)).withColumn("ends", _running(F.col("ends"), _most))
    flat = flat.select(key, text_key, F.transform(F.filter(F.arrays_zip(F.col("at").alias("span"), F.col("ends").alias("ends")), lambda x: x.span.start >= x.ends), lambda x: x.span).alias(held))
    step = F.ceil(F.sqrt(F.size(held).cast("double"))).cast("int")
    whole = docs.join(flat, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text_key)), "left")

    def block(first: Column) -> Column:
        """The text from the end of the span before the block to the end of its last, masked."""
        own = F.slice(held, first, step)
        begin = F.coalesce(F.get(F.col(held), first - 2).stop, F.lit(0))
        end = F.element_at(own, -1).stop
        return F.struct(own.alias("own"), begin.alias("begin"), F.substring(F.col("text"), begin + 1, end - begin).alias("piece"))

    def masked(b: Column) -> Column:
        cut_out = lambda a, x: F.struct(x.stop.alias("at"), F.concat(a.out, F.substring(b.piece, a["at"] - b.begin + 1, x.start - a["at"]), F.lit("<"), F.upper(x.kind), F.lit(">")).alias("out"))
        return F.aggregate(b.own, F.struct(b.begin.alias("at"), F.lit("").alias("out")), cut_out, lambda a: a.out)

    starts = F.sequence(F.lit(1), F.size(held), step)
    tail = F.substring(F.col("text"), F.element_at(F.col(held), -1).stop + 1, F.lit(_LAST))
    text = F.concat(F.array_join(F.transform(F.transform(starts, block), masked), ""), tail)
    return whole.select(*[F.when(F.size(held) > 0, text).otherwise(c).alias(n) if n == "text" else c for n, c in zip(docs.columns, columns(docs), strict=True)])
