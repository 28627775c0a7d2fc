"""Personal data in texts: base patterns and, beyond them, candidates chosen by
gradient boosted trees. DataFrame and SQL functions throughout.

* Base spans are the matches of one pattern per kind that pass its check.
* High-recall generators propose further, overlapping spans: written-out or
  defanged addresses, numbers with unusual separators or prefixes.
* Boosted trees score each proposal from its format (digits, groups,
  separators, the kind's check on the bare form) and its context (neighbouring
  characters, words before it). They learn from the table itself: base spans
  are positive; proposals that fail the kind's check, or are plain numbers
  without any mark of the kind, are negative; the others are what is scored.
  All of them are learned from, equal rows of features as one with a weight.
* Thresholds come from a held-out fold: per kind the lowest score at which the
  share of positives is at least ``precision``. A proposal that reaches its
  threshold becomes a span unless it overlaps a base span or a better
  proposal; base spans always stay.

Patterns are written so that a text is read once from left to right (runs are
taken whole), which leaves the matches unchanged and long texts linear.

Rows: a null or empty text has no spans; rows with equal or null ids stay rows
of their own; equal texts get equal spans; a table without positives or
without negatives has base spans only; an empty table gives an empty result.
Offsets are code points, ends exclusive. Only the id and text columns are
read, so extra columns and clashing names do not matter."""
from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_ids, staged

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# a match begins where a run begins, or where the match before it ended
_RUN = rf"(?:(?<!{_LOCAL})|\G)"
BASE = [
    rf"{_RUN}{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
_OPEN, _CLOSE = r"[(\[{<]\x20?", r"\x20?[)\]}>]"
_AT = rf"(?:\x20?@\x20?|\x20?{_OPEN}(?:at|AT|@){_CLOSE}\x20?)"
_DOT = rf"(?:\.|\x20?{_OPEN}(?:dot|DOT|\.){_CLOSE}\x20?)"
_SEP = r"[\x20\x{A0}._/-]"
WIDE = [
    rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++",
    rf"(?<![0-9.])[0-9]{{1,3}}+(?:(?:\x20?\.\x20?|{_OPEN}\.{_CLOSE})[0-9]{{1,3}}+){{3}}+(?![0-9])",
    rf"(?<![0-9])[0-9](?:{_SEP}{{0,2}}+[0-9]){{11,}}+",
    r"(?<![0-9])(?:\+|\(|00)?\x20?[0-9](?:[\x20\x{A0}()./-]{0,3}+[0-9]){6,}+",
]
# a text that fails this cannot match
_GUARD = [
    lambda t: t.contains("@"),
    lambda t: t.rlike(r"[0-9]\.[0-9]"),
    lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    lambda t: t.contains("+"),
    lambda t: t.contains("@") | t.rlike(rf"{_OPEN}(?:at|AT){_CLOSE}"),
    lambda t: t.rlike(r"[0-9][)\]}>\x20]{0,2}(?:\.|\[|\(|\{|<)"),
    lambda t: t.rlike(r"[0-9](?:[\x20\x{A0}._/-]{0,2}[0-9]){11}"),
    lambda t: t.rlike(r"[0-9](?:[\x20\x{A0}()./-]{0,3}[0-9]){6}"),
]
BEFORE, AFTER = 24, 8
CONTEXT = [
    r"(?i)\b(?:e-?mail|mail|contact|write|address|reach)\b",
    r"(?i)\b(?:ip|host|server|addr|address|client|from)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|account|payment)\b",
    r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp)\b",
]
UNLIKE = r"(?i)(?:\b(?:token|key|sha|hash|id|order|invoice|isbn|issn|version|date|page|no|nr|ref)\b|[=#$€£])"

BALANCE = 2_500
ROWS_A_TASK = 100_000
MIN_CLASS = 5
PRECISION = 0.95
FOLDS = 4


def _check(kind: Column, bare: Column) -> Column:
    """The kind's check on digits and dots alone."""
    digits = F.regexp_replace(bare, "[^0-9]", "")
    n = F.length(digits)
    parts = F.regexp_extract_all(bare, F.lit("[0-9]+"), F.lit(0))
    small = F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        parts, lambda p: F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3).cast("int") <= 255)
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for k in range(19):
        d = F.substring(padded, 19 - k, 1).cast("int")
        total = total + (d if k % 2 == 0 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return (F.when(kind == EMAIL, F.lit(True)).when(kind == IP, small)
            .when(kind == CARD, n.between(12, 19) & (total % 10 == 0))
            .otherwise(n.between(9, 15)))


def candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rid, kind, wide, start, stop, match, before, after`` of every match
    of the base patterns and the generators. Texts without a match leave the
    row at once; offsets are running sums over the pieces between matches."""
    t = F.col(text)
    patterns = BASE + WIDE
    found = [F.struct(F.lit(i).alias("pattern"), F.when(may(t), F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias("matches"))
             for i, (p, may) in enumerate(zip(patterns, _GUARD))]
    hits = rows.filter(F.length(t) > 0).select("rid", t.alias("text"), F.inline(F.array(*found)))
    hits = hits.filter(F.size(F.coalesce("matches", F.array().cast("array<string>"))) > 0)
    pieces = reduce(lambda c, ip: c.when(F.col("pattern") == ip[0], F.split("text", ip[1], -1)), enumerate(patterns), F)
    hits = hits.select("rid", "pattern", "matches", F.transform(pieces, lambda g: F.struct(
        F.length(g).alias("n"), F.substring(g, -BEFORE, BEFORE).alias("tail"), F.substring(g, 1, AFTER).alias("head"))).alias("gaps"))
    each = hits.select("rid", "pattern", F.posexplode(F.arrays_zip(
        F.col("matches").alias("match"), F.col("gaps").alias("gap"), F.slice("gaps", F.lit(2), F.size("gaps")).alias("next"))))
    each = each.filter(F.col("col.match").isNotNull()).select(
        "rid", "pattern", "pos", "col.match", F.col("col.gap.n").alias("skip"),
        F.col("col.gap.tail").alias("before"), F.col("col.next.head").alias("after"))
    order = Window.partitionBy("rid", "pattern").orderBy("pos")
    stop = F.sum(F.col("skip") + F.length("match")).over(order)
    return each.select("rid", (F.col("pattern") % 4).alias("kind"), (F.col("pattern") >= 4).alias("wide"),
                       (stop - F.length("match")).cast("bigint").alias("start"), stop.cast("bigint").alias("stop"),
                       "match", "before", "after")


# -- features ------------------------------------------------------------------

def _bare(kind: Column, match: Column) -> Column:
    """The match without the marks that a generator allows and a base pattern
    does not."""
    dots = F.regexp_replace(match, rf"\x20?{_OPEN}(?:dot|DOT|\.){_CLOSE}\x20?", ".")
    return F.when(kind <= IP, F.regexp_replace(dots, r"\x20", "")).otherwise(match)


FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "valid", "n_digits", "n_chars", "n_groups", "longest", "shortest",
            "n_separators", "prefixed", "brackets", "leading_zero", "joined_left", "joined_right", "likely_words", "unlike_words"]


def with_features(found: DataFrame) -> DataFrame:
    """Format and context features beside every candidate."""
    kind, match = F.col("kind"), F.col("match")
    bare = _bare(kind, match)
    groups = F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(groups, F.length)
    left = F.regexp_extract("before", r"\S*$", 0)
    likely = reduce(lambda c, iw: c.when(kind == iw[0], F.col("before").rlike(iw[1])), enumerate(CONTEXT), F)
    separators = F.array_size(F.array_distinct(F.regexp_extract_all(match, F.lit("[^0-9A-Za-z]"), F.lit(0))))
    values = {
        **{f"is_{name}": kind == i for i, name in enumerate(KINDS)},
        "valid": _check(kind, bare), "n_digits": F.length(F.regexp_replace(match, "[^0-9]", "")), "n_chars": F.length(match),
        "n_groups": F.size(groups), "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "n_separators": separators, "prefixed": match.rlike(r"^(?:\+|00)"), "brackets": match.rlike(r"[()\[\]{}<>]"),
        "leading_zero": match.rlike("^0"), "joined_left": left.rlike(r"[\p{L}\p{N}_]$"), "joined_right": F.col("after").rlike(r"^[\p{L}\p{N}_@]"),
        "likely_words": likely, "unlike_words": F.col("before").rlike(UNLIKE),
    }
    return found.withColumns({name: values[name].cast("double") for name in FEATURES})


def _marked(kind: Column) -> Column:
    """Whether a proposal bears a mark of its kind beyond plain digits."""
    return (F.when(kind <= IP, F.lit(True))
            .when(kind == CARD, (F.col("n_groups") >= 3) & (F.col("longest") <= 6) & (F.col("unlike_words") == 0))
            .otherwise(((F.col("prefixed") == 1) | (F.col("likely_words") == 1)) & (F.col("unlike_words") == 0)))


# -- the model -----------------------------------------------------------------

def _distinct(labelled: DataFrame) -> DataFrame:
    """Every labelled candidate, as its features with the number ``n`` of
    candidates that share them; a quarter of the candidates is ``held`` out."""
    held = F.pmod(F.xxhash64("rid", "start", F.lit("fold")), F.lit(FOLDS)) == 0
    rows = labelled.select("kind", "label", held.alias("held"), *FEATURES)
    return rows.groupBy("kind", "label", "held", *FEATURES).agg(F.count(F.lit(1)).alias("n"))


def train(labelled: DataFrame, balance: int = BALANCE, precision: float = PRECISION
          ) -> tuple[GBTClassificationModel, dict[int, float]] | None:
    """The trees and the threshold of each kind; None where a class is
    missing. ``labelled``: candidates with features and ``label``. All of them
    count: the trees see each distinct row of features weighted by its number
    (a kind and label weighs ``balance`` at most, so that frequent ones do not
    drown the others), thresholds come from all that are held out."""
    counts = staged(_distinct(labelled), "pii-counts")
    sizes = counts.groupBy("kind", "label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("learned"),
                                                F.count(F.lit(1)).alias("rows")).collect()
    classes = [sum(r["learned"] for r in sizes if r["label"] == label) for label in (0.0, 1.0)]
    if min(classes) < MIN_CLASS:
        return None
    share = reduce(lambda c, r: c.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), min(1.0, balance / r["n"])), sizes, F)
    learn = _vectors(counts.filter(~F.col("held"))).select("features", "label", (F.col("n") * share).alias("weight"))
    learn = learn.coalesce(max(4, sum(r["rows"] for r in sizes) // ROWS_A_TASK))
    model = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, seed=7, checkpointInterval=-1, weightCol="weight").fit(learn)
    bins = (with_score(counts.filter("held"), model).groupBy("kind", F.floor(F.col("score") * 100).alias("bin"))
            .agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect())
    thresholds = {}
    for kind in range(len(KINDS)):
        good = total = 0.0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            good, total = good + r["good"], total + r["n"]
            if r["bin"] >= 50 and good >= precision * total:
                thresholds[kind] = r["bin"] / 100
    return model, thresholds


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(df)


def with_score(df: DataFrame, model: GBTClassificationModel) -> DataFrame:
    scored = model.transform(_vectors(df)).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


# -- spans ---------------------------------------------------------------------

def _clear_of_base(spans: DataFrame) -> DataFrame:
    """Proposals that overlap no base span, by running maxima and minima along
    the text."""
    along = Window.partitionBy("rid").orderBy("start", "stop")
    base_stop, base_start = F.when(F.col("base"), F.col("stop")), F.when(F.col("base"), F.col("start"))
    reached = F.max(base_stop).over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    coming = F.min(base_start).over(along.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    seen = spans.withColumn("reached", reached).withColumn("coming", coming)
    clear = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("coming", F.col("stop")) >= F.col("stop"))
    return seen.filter(~F.col("base") & clear).drop("reached", "coming")


def _best_of_overlaps(spans: DataFrame) -> DataFrame:
    """Of each run of overlapping proposals the best one."""
    along = Window.partitionBy("rid").orderBy("start", "stop", "kind")
    earlier = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", (F.coalesce(earlier, F.lit(-1)) <= F.col("start")).cast("int"))
    marked = marked.withColumn("island", F.sum("opens").over(along))
    best = Window.partitionBy("rid", "island").orderBy(F.desc("score"), F.desc(F.col("stop") - F.col("start")), "start", "kind")
    return marked.withColumn("place", F.row_number().over(best)).filter(F.col("place") == 1).drop("opens", "island", "place")


def find_spans(rows: DataFrame, balance: int = BALANCE, precision: float = PRECISION) -> DataFrame:
    """``rid, kind, start, stop, base, score`` of all spans (score null for
    base spans) of ``rows`` (rid, text)."""
    found = staged(candidates(rows), "pii-candidates")
    base = found.filter(~F.col("wide")).filter(_check(F.col("kind"), F.col("match")))
    same = base.select("rid", "kind", "start", "stop")
    proposed = found.filter("wide").join(same, ["rid", "kind", "start", "stop"], "left_anti")
    cols = ["rid", "kind", "start", "stop"]
    positive = with_features(base).withColumn("label", F.lit(1.0))
    negative = with_features(proposed).filter((F.col("valid") == 0) | ~_marked(F.col("kind"))).withColumn("label", F.lit(0.0))
    fitted = train(positive.unionByName(negative), balance, precision)
    plain = base.select(*cols, F.lit(True).alias("base"), F.lit(None).cast("double").alias("score"))
    if fitted is None:
        return plain
    model, thresholds = fitted
    least = reduce(lambda c, kt: c.when(F.col("kind") == kt[0], kt[1]), thresholds.items(), F.when(F.lit(False), 2.0)).otherwise(2.0)
    chosen = with_score(with_features(proposed), model).filter(F.col("score") >= least)
    chosen = chosen.select(*cols, F.lit(False).alias("base"), "score")
    added = _best_of_overlaps(_clear_of_base(plain.unionByName(chosen)))
    return plain.unionByName(added)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", balance: int = BALANCE,
                       precision: float = PRECISION) -> DataFrame:
    """``doc_id, spans``: for every row its spans (array of start, kind, stop,
    base, score) by start and kind."""
    rows = row_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", ["text"])
    spans = find_spans(rows.select("rid", "text"), balance, precision)
    per_row = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "base", "score"))).alias("spans"))
    empty = F.array().cast(per_row.schema["spans"].dataType)
    return rows.select("rid", "doc_id").join(per_row, "rid", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in brackets;
    overlapping spans become one, named after the first."""
    rows = row_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", ["text"])
    spans = find_spans(rows.select("rid", "text"))
    along = Window.partitionBy("rid").orderBy("start", "kind", "stop")
    earlier = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", (F.coalesce(earlier, F.lit(-1)) <= F.col("start")).cast("int"))
    spans = spans.withColumn("island", F.sum("opens").over(along))
    merged = spans.groupBy("rid", "island").agg(F.min(F.struct("start", "kind")).alias("first"), F.max("stop").alias("stop"))
    along = Window.partitionBy("rid").orderBy("island")
    merged = merged.withColumn("from", F.coalesce(F.lag("stop").over(along), F.lit(0)))
    merged = merged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("from", F.col("first.start").alias("start"), F.col("first.kind").alias("kind"), "stop"))).alias("cuts"))
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    kept = rows.join(merged, "rid", "left").withColumn("last", F.coalesce(F.element_at("cuts", -1)["stop"], F.lit(0)))
    pieces = F.transform("cuts", lambda c: F.concat(F.substring(F.col("text"), c["from"] + 1, c["start"] - c["from"]), name[c["kind"]]))
    rest = F.substring(F.col("text"), F.col("last") + 1, F.length("text"))
    return kept.select("doc_id", F.concat(F.coalesce(F.array_join(pieces, ""), F.lit("")), F.coalesce(rest, F.lit(""))).alias("text"))
