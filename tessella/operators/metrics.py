"""Text similarity and translation metrics: chrF++ in three forms, BLEU for sentences and corpora, token F1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import ratcliff, score_counts, text_overlaps
from ..functions.dialect import let, strip, sub, text_of, tokens

CHARS, WORDS, ORDERS = (1, 2, 3, 4, 5, 6), (1, 2), (1, 2, 3, 4)

# ---- one row at a time ----


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of lower-case words; two empty texts are equal."""
    x, y = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
    both = F.size(F.array_intersect(x, y))
    f1 = F.when(both == 0, 0.0).otherwise(2 * both / (F.size(x) + F.size(y)))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(f1)


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity without case."""
    return ratcliff(F.lower(a), F.lower(b))


def round_trip_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity with case, without marks in angle brackets and white space at the ends."""
    bare = lambda c: strip(sub(c, (r"<[^>]+>", "")))
    return ratcliff(bare(a), bare(b))


def combined_similarity(a: Column, b: Column) -> Column:
    return 0.7 * ratio(a, b) + 0.3 * token_f1(a, b)


def round_trip(original: Column, back: Column, valid_from: float = 0.3) -> Column:
    """A struct for a text and what came back: score, roundtrip_text, lev_similarity, f1_similarity, is_valid."""
    x, y = text_of(original), text_of(back)

    def record(parts: Column) -> Column:
        score = 0.7 * parts["lev"] + 0.3 * parts["f1"]
        return F.struct(score.alias("score"), y.alias("roundtrip_text"), parts["lev"].alias("lev_similarity"), parts["f1"].alias("f1_similarity"), (score >= valid_from).alias("is_valid"))

    return let(F.struct(round_trip_similarity(x, y).alias("lev"), token_f1(x, y).alias("f1")), record)


def confidence(score: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(score))), F.lit(0.5))


def fluency(text: Column) -> Column:
    n = F.size(tokens(text))
    return F.when(n.between(5, 20), 1.0).when(n.between(3, 25), 0.8).otherwise(0.5)


def length_fit(source: Column, text: Column) -> Column:
    share = F.size(tokens(text)) / F.greatest(F.lit(1), F.size(tokens(source)))
    return F.when(share.between(0.8, 1.5), 1.0).when(share.between(0.5, 2.0), 0.8).otherwise(0.5)


def geo_mean(bleu: Column, chrf: Column) -> Column:
    return F.when((bleu <= 0) | (chrf <= 0), 0.0).otherwise(F.sqrt(bleu * chrf))


# ---- pairs of texts, by counted n-grams ----


def _f(p: Column, r: Column, beta: float = 2.0) -> Column:
    return F.when(p + r > 0, (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(0.0)


def _share(common: Column, of: Column) -> Column:
    return F.coalesce(common / F.nullif(of, F.lit(0)), F.lit(0.0))


def _total(overlaps: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(overlaps, F.lit(0.0), lambda acc, o: acc + value(o))


def chrf(a: Column, b: Column) -> Column:
    """chrF++ from 0 to 100: the mean of the F scores of six character and two word orders; an order that a text lacks counts 0."""
    x, y = text_of(a), text_of(b)
    f = lambda o: _f(_share(o["common"], o["in_a"]), _share(o["common"], o["in_b"]))
    mean = _total(text_overlaps(x, y, CHARS, WORDS), f) / (len(CHARS) + len(WORDS)) * 100
    return F.when((x == "") & (y == ""), 100.0).when((x == "") | (y == ""), 0.0).otherwise(mean)


def mean_chrf(a: Column, b: Column) -> Column:
    """chrF++ from 0 to 1: the F score of the mean precision and mean recall over the eight orders."""
    n, x, y = len(CHARS) + len(WORDS), text_of(a), text_of(b)

    def value(overlaps: Column) -> Column:
        means = F.struct((_total(overlaps, lambda o: _share(o["common"], o["in_a"])) / n).alias("p"), (_total(overlaps, lambda o: _share(o["common"], o["in_b"])) / n).alias("r"))
        return let(means, lambda m: _f(m["p"], m["r"]))

    return F.when((x == "") | (y == ""), 0.0).otherwise(let(text_overlaps(x, y, CHARS, WORDS), value))


def bleu(a: Column, b: Column) -> Column:
    """BLEU from 0 to 100 of ``a`` against ``b`` with one added to every count, so an order that ``a`` lacks has precision 1."""
    x, y = text_of(a), text_of(b)

    def value(overlaps: Column) -> Column:
        n, m = F.element_at(overlaps, 1)["in_a"], F.element_at(overlaps, 1)["in_b"]
        logs = _total(overlaps, lambda o: F.log((o["common"] + 1) / (o["in_a"] + 1))) / len(ORDERS)
        brevity = F.least(F.lit(1.0), F.exp(1.0 - m / F.greatest(n, F.lit(1))))
        return F.when((n == 0) | (m == 0), 0.0).otherwise(brevity * F.exp(logs) * 100)

    return let(text_overlaps(x, y, (), ORDERS), value)


def bleu_chrf(a: Column, b: Column) -> Column:
    return geo_mean(bleu(a, b), chrf(a, b))


#: A utility is a function of two text columns.
Utility = Callable[[Column, Column], Column]
UTILITIES: dict[str, Utility] = {"chrf": chrf, "bleu": bleu, "geo_mean": bleu_chrf}


def utility(name: str | Utility) -> Utility:
    """A utility by name; a function of two columns, a UDF among them, serves as it is. Other names raise ValueError."""
    if not isinstance(name, str):
        return name
    if name not in UTILITIES:
        raise ValueError(f"no utility {name}; there are {', '.join(UTILITIES)}")
    return UTILITIES[name]


# ---- corpora ----


def corpus_scores(rows: DataFrame, hypothesis: str, reference: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``by``, n, bleu, chrf, geo_mean of all rows, or of each group; from 0 to 100, rounded to four places.

    BLEU: 13a tokens, orders 1 to 4, counts summed over the corpus, orders without a match halved
    ever more (exponential smoothing), brevity penalty. chrF++: characters without blanks, words
    with their marks apart, beta 2, means of precision and recall over the orders that both sides
    have. NULL texts are empty.
    """
    clean = rows.select(*by, F.coalesce(hypothesis, F.lit("")).alias("h"), F.coalesce(reference, F.lit("")).alias("r"))

    # counts of a row stay in the row; only their sums are shuffled
    counts = score_counts(F.col("h"), F.col("r"), (("b", ORDERS), ("w", WORDS), ("char", CHARS)))
    each = clean.select(*by, F.explode(counts).alias("o")).select(*by, F.left("o.kind", F.lit(1)).alias("kind"), "o.n", F.col("o.common").alias("m"), F.col("o.in_a").alias("h"), F.col("o.in_b").alias("r"))
    # in chrF a hypothesis counts only where its reference has the order
    counted = F.when((F.col("kind") == "b") | (F.col("r") > 0), F.col("h")).otherwise(0)
    total = each.groupBy(*by, "kind", "n").agg(F.sum("m").alias("m"), F.sum(counted).alias("h"), F.sum("r").alias("r"))
    packed = total.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", "n").alias("k"), F.struct("m", "h", "r").alias("v")))).alias("t"))
    at = lambda k, f: F.coalesce(F.try_element_at(F.col("t"), F.lit(k))[f], F.lit(0)).cast("double")
    logs, halvings = F.lit(0.0), F.lit(0)
    for n in ORDERS:
        m, h = at(f"b{n}", "m"), at(f"b{n}", "h")
        halvings = F.when((m == 0) & (h > 0), halvings + 1).otherwise(halvings)
        p = F.when(h == 0, 0.0).when(m == 0, 1.0 / (F.pow(F.lit(2.0), halvings) * h)).otherwise(m / h)
        logs = logs + F.when(p > 0, F.log(p)).otherwise(-9999999999.0)
    h, r = at("b1", "h"), at("b1", "r")
    brevity = F.when(h >= r, 1.0).when(h > 0, F.exp(1 - r / F.greatest(h, F.lit(1.0)))).otherwise(0.0)
    some = sum((at(f"b{n}", "m") for n in ORDERS), F.lit(0.0)) > 0
    bleu = F.when(some, 100 * brevity * F.exp(logs / len(ORDERS))).otherwise(0.0)
    orders = [f"c{n}" for n in CHARS] + [f"w{n}" for n in WORDS]
    use = lambda k: (at(k, "h") > 0) & (at(k, "r") > 0)
    n_orders = sum((use(k).cast("int") for k in orders), F.lit(0))
    mean = lambda f: F.coalesce(sum((F.when(use(k), at(k, "m") / at(k, f)).otherwise(0.0) for k in orders), F.lit(0.0)) / F.nullif(n_orders, F.lit(0)), F.lit(0.0))
    sizes = clean.groupBy(*by).agg(F.count("*").alias("n"))
    joined = sizes.join(packed, list(by), "left") if by else sizes.crossJoin(packed)  # one row each
    scored = joined.select(*by, "n", F.coalesce(bleu, F.lit(0.0)).alias("bleu"), mean("h").alias("p"), mean("r").alias("q"))
    scored = scored.select(*by, "n", "bleu", (100 * F.coalesce(_f(F.col("p"), F.col("q")), F.lit(0.0))).alias("chrf"))
    return scored.select(*by, "n", F.bround("bleu", 4).alias("bleu"), F.bround("chrf", 4).alias("chrf"), F.bround(F.sqrt(F.col("bleu") * F.col("chrf")), 4).alias("geo_mean"))


def evaluate(predictions: DataFrame, references: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """Corpus scores of two tables by id; empty tables, and tables whose ids are not the same, raise ValueError."""
    sizes = predictions.select(F.col(id).alias("k"), F.lit(1).alias("p"), F.lit(0).alias("r")).union(references.select(F.col(id).alias("k"), F.lit(0).alias("p"), F.lit(1).alias("r")))
    sizes = sizes.groupBy("k").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    p, r, apart = sizes.agg(F.sum("p"), F.sum("r"), F.count_if((F.col("p") != 1) | (F.col("r") != 1))).first()
    for name, n in (("predictions", p), ("references", r)):
        if not n:
            raise ValueError(f"no {name}")
    if p != r or apart:
        raise ValueError(f"{p} predictions against {r} references; {apart} ids are not in both once")
    a = predictions.select(F.col(id).alias("k"), F.col(text).alias("prediction"))
    b = references.select(F.col(id).alias("j"), F.col(text).alias("reference"))
    return corpus_scores(a.join(b, F.col("k").eqNullSafe(F.col("j"))), "prediction", "reference")


def training_scores(rows: DataFrame, prediction: Column, label: Column, clean: Callable[[Column], Column]) -> DataFrame:
    """Columns bleu, chrf of cleaned predictions and labels, a full stop for blank ones."""
    side = lambda c: let(clean(text_of(c)), lambda t: F.when(strip(t) == "", F.lit(".")).otherwise(t))
    return corpus_scores(rows.select(side(prediction).alias("p"), side(label).alias("l")), "p", "l").select("bleu", "chrf")
