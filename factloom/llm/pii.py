"""Personal data: base spans by pattern, and terms that give the protected entities away, in DataFrame operations only.

Every value found by a base pattern is a protected entity. Words near an entity's occurrences (WINDOW code points to
either side) co-occur with it. Over the whole table, with N words, S_e words near entity e, c_t occurrences of
term t and c_et of them near e, pointwise mutual information is PMI = log2(c_et N / (S_e c_t)), and an entity's own
information content is IC = -log2(S_e / N). A term discloses e to the degree PMI / IC, which is 1 when t occurs nowhere
else. With c_et of at least SUPPORT, terms at REMOVE or more are removed, those at GENERALISE or more are generalised, and since
such a term points to e wherever it is read, every occurrence of it in any text becomes a span of kind `term`. SUPPORT is two: a
word that occurs once stands near whatever it stands near, which tells nothing of an association, so one co-occurrence is no
estimate; an entity named once has no terms for that reason.

Patterns run once; what they find and the words around are written. Contexts are linear in the number of spans. Only (entity, term)
counts are shuffled, after partial aggregation; a term or an entity with very many partners is joined by broadcast of its one row.
Words of the corpus are counted in one pass; candidate terms are broadcast only while they are few (BROADCAST_ROWS), else joined
by shuffle. Null text is empty; repeated rows stay, each with the spans of its own text, whatever its doc_id is or lacks; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import BROADCAST_ROWS, bounded, join_skewed, listed, masked, spans_of, table, with_matches

#: Fixed patterns of the base kinds, in the order in which kinds are listed. Possessive, so that long runs stay linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WINDOW = 64
SUPPORT = 2
GENERALISE = 0.85
REMOVE = 0.95
_WORD = r"\p{L}{3,}"
_NO_SPANS = "array<struct<s:int,o:int,k:string,e:int,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string fits."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _fits(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.try_cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _fitting(kind: str):
    return lambda x: _fits(kind, x["m"])


def base_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep`, __text, and for each kind its spans, with `base`: all of them by kind as listed, then start."""
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    df = with_matches(df, "__text", PATTERNS, {"email": F.contains("__text", F.lit("@")), "phone": F.contains("__text", F.lit("+"))})
    df = df.select(*keep, "__text", *[spans_of(k, i).alias(k) for i, k in enumerate(PATTERNS)])
    df = df.withColumns({k: F.filter(k, _fitting(k)) for k in ("ip", "card", "phone")})
    return df.withColumn("base", F.concat(*PATTERNS))


def _sides(text: Column) -> Column:
    """The texts on both sides of every base span, with its entity and whether either end may cut a word."""

    def around(x: Column) -> Column:
        entity = F.concat(x["k"], F.lit(":"), F.when(x["k"] == "email", F.lower(x["m"])).when(x["k"] == "ip", x["m"]).otherwise(_digits(x["m"])))
        begin = F.greatest(F.lit(0), x["s"] - WINDOW)
        return F.array(
            F.struct(entity.alias("entity"), F.substring(text, begin + 1, x["s"] - begin).alias("side"), (begin > 0).alias("cut_l"), F.lit(False).alias("cut_r")),
            F.struct(entity.alias("entity"), F.substring(text, x["e"] + 1, F.lit(WINDOW)).alias("side"), F.lit(False).alias("cut_l"), (x["e"] + WINDOW < F.length(text)).alias("cut_r")),
        )

    return F.flatten(F.transform("base", around))


def contexts(found: DataFrame) -> DataFrame:
    """(entity, term): every word near every base span."""
    near = found.where(F.size("base") > 0).select(F.explode("sides").alias("x")).select("x.*")
    near = with_matches(near, "side", {"term": _WORD}).withColumn("words", spans_of("term", len(PATTERNS)))
    whole = lambda w: ~(F.col("cut_l") & (w["s"] == 0)) & ~(F.col("cut_r") & (w["e"] == F.length("side")))
    return near.select("entity", F.explode(F.filter("words", whole)["m"]).alias("term")).withColumn("term", F.lower("term"))


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` and term: every word of every text."""
    every = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(_WORD), F.lit(0))
    # An outer explode: of an inner one the optimiser would make a filter that finds all words once more.
    return docs.select(*keep, F.explode_outer(every if not keep else F.array_distinct(every)).alias("term")).where("term IS NOT NULL").withColumn("term", F.lower("term"))


def disclosures(docs: DataFrame, near: DataFrame) -> DataFrame:
    """(entity, term, degree) for pairs with support whose degree is at least GENERALISE."""
    pairs = table(near.groupBy("entity", "term").agg(F.count("*").alias("c_et")), "pii-pairs")
    sizes = table(pairs.groupBy("entity").agg(F.sum("c_et").alias("s_e"), F.count_if(F.col("c_et") >= SUPPORT).alias("group_size")), "pii-entities")
    pairs = pairs.where(F.col("c_et") >= SUPPORT)
    terms = table(pairs.groupBy("term").agg(F.count("*").alias("group_size")), "pii-terms")
    few = terms.count() <= BROADCAST_ROWS
    known = terms.select("term", F.lit(True).alias("candidate"))
    if few:  # words that are no candidates are only counted together
        said = _words(docs).join(F.broadcast(known), "term", "left").select(F.when(F.col("candidate"), F.col("term")).alias("term"))
        counted = said.groupBy("term").agg(F.count("*").alias("c_t"))
    else:
        counted = _words(docs).groupBy("term").agg(F.count("*").alias("c_t")).join(known, "term", "left")
        counted = counted.groupBy(F.when(F.col("candidate"), F.col("term")).alias("term")).agg(F.sum("c_t").alias("c_t"))
    counted = table(counted, "pii-words")
    n = counted.agg(F.sum("c_t")).first()[0] or 1
    total = pairs.count()
    joined = join_skewed(pairs, counted.where("term IS NOT NULL"), "term", terms, total)
    joined = join_skewed(joined, sizes.select("entity", "s_e"), "entity", sizes.select("entity", "group_size"), total)
    content = -F.log2(F.col("s_e") / n)
    degree = F.least(F.lit(1.0), 1 + F.log2(F.col("c_et") / F.col("c_t")) / content)
    return joined.where(F.col("s_e") < n).select("entity", "term", degree.alias("degree")).where(F.col("degree") >= GENERALISE)


def _own(left: str, right: str) -> Column:
    """Rows of the same doc_id (or of none) and the same text."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.fp") == F.col(f"{right}.fp"))


def occurrences(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """(doc_id, fp, term): for texts of docs (doc_id, fp, text) with telling terms, the spans of all of them."""
    mark = bounded(telling)
    # First which texts have any, then the places of those alone.
    holders = table(_words(docs, "doc_id", "fp").join(mark, "term", "left_semi").select("doc_id", "fp").distinct(), "pii-holders")
    texts = docs.alias("a").join(bounded(holders).alias("b"), _own("a", "b"), "left_semi").dropDuplicates(["doc_id", "fp"])
    both = with_matches(texts, "text", {"term": _WORD}).select("doc_id", "fp", F.posexplode(F.arrays_zip("term_m", "term_g")).alias("place", "x"))
    # A word ends where all gaps and words up to it end.
    so_far = W.partitionBy("doc_id", "fp").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    words = both.where("x.term_m IS NOT NULL").select("doc_id", "fp", F.col("x.term_m").alias("word"), F.sum(F.length("x.term_g") + F.length("x.term_m")).over(so_far).cast("int").alias("e"))
    words = words.select("doc_id", "fp", (F.col("e") - F.length("word")).alias("s"), "e", F.lower("word").alias("term"))
    span = F.struct("s", F.lit(len(PATTERNS)).alias("o"), F.lit("term").alias("k"), "e", F.when(F.col("degree") >= REMOVE, "remove").otherwise("generalise").alias("m"))
    # What one text holds, at most its own words.
    return words.join(mark, "term").groupBy("doc_id", "fp").agg(F.array_sort(F.collect_list(span)).alias("term"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, n_email, n_ip, n_card, n_phone, base, term): spans of base kinds, and the added ones, for every row.

    fp is a hash of the text: spans belong to a text, so (doc_id, fp) is as good as a row.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("fp"), "text")
    found = base_spans(rows, "doc_id", "fp").withColumn("sides", _sides(F.col("__text")))
    base = table(found.select("doc_id", "fp", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], "base", "sides"), "pii-base", scan=True)
    degrees = disclosures(docs, contexts(base))
    telling = table(degrees.groupBy("term").agg(F.max("degree").alias("degree")), "pii-telling")
    by_text = table(occurrences(rows, telling), "pii-terms-by-text")
    df = base.drop("sides").alias("a").join(by_text.alias("b"), _own("a", "b"), "left").select("a.*", "b.term")
    off = F.filter("term", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return df.withColumn("term", F.when(F.col("term").isNull(), F.array().cast(_NO_SPANS)).otherwise(off))


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): base spans become [kind], terms [generalise] or [remove]; a null text stays null. Rows that repeat stay."""
    marks = lambda x: F.struct(x["s"], x["o"], F.when(x["k"] == "term", x["m"]).otherwise(x["k"]).alias("k"), x["e"], x["m"])
    spans = scan(docs).select("doc_id", "fp", F.array_sort(F.transform(F.concat("base", "term"), marks)).alias("spans")).dropDuplicates(["doc_id", "fp"])
    rows = docs.select("doc_id", F.xxhash64("text").alias("fp"), "text")
    return rows.alias("a").join(spans.alias("b"), _own("a", "b"), "left").select("a.doc_id", "a.text", "b.spans").select("doc_id", masked(F.col("text"), "spans").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    df = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.concat("base", "term")
    return df.select("doc_id", *[f"n_{k}" for k in PATTERNS], F.size("term").cast("long").alias("n_term"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(spans).alias("spans"))
