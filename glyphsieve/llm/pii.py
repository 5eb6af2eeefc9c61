"""Information-theoretic sanitisation of personal data.

Protected entities are identifiers: mail addresses, telephone, card and account numbers, internet addresses. How strongly a term reveals one is estimated from
where both occur in the corpus: the pointwise mutual information of term and entity, as a share of the entity's own information content, is 1 if the term tells
the entity as surely as its own name. Entities disclose themselves and become their kind; terms from GENERALISE on become their shape, from REMOVE on they go.

Counts are of distinct passages or, if asked, of distinct whole texts, so that exact copies of a document prove nothing. Everything is built-in
functions; what is shuffled are entities, the texts that hold one of those that enough texts hold, their terms and the counts of these, not the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm._common import fresh, materialise, measured_side
from glyphsieve.sources.tables import read_table

#: Kind and pattern of entities; earlier ones win where both match.
KINDS = {
    "EMAIL": "[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}([.][A-Za-z0-9-]{1,63}){0,8}[.][A-Za-z]{2,24}",
    "ACCOUNT": "\\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){3,7}( ?[A-Z0-9]{1,3})?\\b",
    "CARD": "\\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}\\b",
    "PHONE": "[+][0-9]{1,3}[ -]?[(]?[0-9]{2,4}[)]?([ -]?[0-9]{2,4}){2,4}\\b|[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}\\b|\\b[0-9]{3}-[0-9]{3}-[0-9]{4}\\b",
    "NUMBER": "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b",
    "ADDRESS": "\\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\\b",
}
ENTITY = "|".join(f"({p})" for p in KINDS.values()).replace("(", "(?:").replace("[(?:]", "[(]")  # groups would end up among the matches
#: What every entity has.
SIGN = "[0-9@]"
#: Words on either side of an entity that are taken as said with it.
WINDOW = 8
#: Characters on either side in which these words are sought.
REACH = 160
#: A term and an entity must come together in so many distinct texts (passages), and a term must be so long.
MIN_JOINT = 3
MIN_CHARS = 3
GENERALISE = 0.75
REMOVE = 0.9
TERM = "[\\p{L}\\p{N}]+"
NOT_TERM = "[^\\p{L}\\p{N}]+"


def has_entity(text: Column) -> Column:
    return text.rlike(SIGN) & text.rlike(ENTITY)


def _kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(entity.rlike(f"^({pattern})$"), F.lit(kind)).otherwise(out)
    return out


def mentions(docs: DataFrame) -> DataFrame:
    """(passage, entity, terms): each distinct passage about an entity once: the hash of its words, the entity (lower case, its letters and digits), the distinct terms beside it."""
    rows = docs.where(has_entity(F.col("text"))).select(F.regexp_extract_all("text", F.lit(f"({ENTITY})"), F.lit(1)).alias("found"), F.split("text", ENTITY).alias("gaps"))
    one = rows.select("gaps", F.posexplode("found").alias("i", "x"))
    terms = lambda c: F.filter(F.split(F.lower(c), NOT_TERM), lambda w: w != "")
    gap = lambda k: F.coalesce(F.get("gaps", k), F.lit(""))
    before, after = terms(F.right(gap(F.col("i")), F.lit(REACH))), terms(F.left(gap(F.col("i") + 1), F.lit(REACH)))
    # a word that REACH cuts is none
    before = F.when(F.length(gap(F.col("i"))) > REACH, F.slice(before, F.lit(2), F.size(before))).otherwise(before)
    after = F.when(F.length(gap(F.col("i") + 1)) > REACH, F.slice(after, F.lit(1), F.greatest(F.size(after) - 1, F.lit(0)))).otherwise(after)
    last = F.slice(before, F.greatest(F.size(before) - WINDOW + 1, F.lit(1)), F.lit(WINDOW))
    said = one.select(_name(F.col("x")).alias("entity"), F.concat(last, F.slice(after, F.lit(1), F.lit(WINDOW))).alias("words"))
    said = said.select("entity", F.xxhash64("entity", "words").alias("passage"), F.array_distinct(F.filter("words", lambda w: F.length(w) >= MIN_CHARS)).alias("terms"))
    return said.dropDuplicates(["entity", "passage"])


def _name(x: Column) -> Column:
    """An entity as it is counted: lower case, its letters and digits."""
    return F.lower(F.regexp_replace(x, "[^A-Za-z0-9@.]+", ""))


def holders(docs: DataFrame, joint: int) -> tuple[DataFrame, DataFrame]:
    """(passage, entity) of the entities that at least `joint` distinct texts hold, passage being the hash of a text; and (passage, terms) of these texts: the
    distinct terms outside all entities, wherever they stand. Entities in fewer texts can't come together with a term in so many."""
    found = docs.where(has_entity(F.col("text"))).select(F.xxhash64("text").alias("passage"), F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({ENTITY})"), F.lit(1)), _name)).alias("entities"))
    found = materialise(found.select("passage", F.explode("entities").alias("entity")).distinct())
    often = materialise(found.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= joint).select("entity"))
    held = materialise(found.join(measured_side(often), "entity", "left_semi"))
    asked = materialise(held.select("passage").distinct())
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("passage"), "text").join(measured_side(asked), "passage", "left_semi")
    terms = F.array_distinct(F.filter(F.split(F.lower(F.array_join(F.split("text", ENTITY), " ")), NOT_TERM), lambda w: F.length(w) >= MIN_CHARS))
    return held, texts.select("passage", terms.alias("terms")).dropDuplicates(["passage"])


def disclosing_terms(docs: DataFrame, generalise: float = GENERALISE, joint: int = MIN_JOINT, whole: bool = False) -> DataFrame:
    """(term, entity, disclosure) of the terms whose disclosure of some entity reaches `generalise`: for each term, the entity that it reveals most.

    Probabilities are shares of N, the distinct texts and the distinct passages: n(e) passages about the entity, n(t) distinct texts with the term, n(t, e) passages
    with both, and n(t) is taken to be n(t, e) at least. Disclosure is log(n(t, e) N / (n(t) n(e))) / log(N / n(e)), 1 at most.
    With `whole`, N, n(e) and n(t, e) are of distinct texts, and a term need not stand near the entity; an entity that all texts hold has no information.
    """
    if whole:
        said, terms = holders(docs, joint)
        beside = said.join(terms, "passage")
    else:
        said = beside = materialise(mentions(docs))
    pairs = beside.select("entity", F.explode("terms").alias("term")).groupBy("term", "entity").agg(F.count("*").alias("both")).where(F.col("both") >= joint)
    pairs = materialise(pairs)
    asked = materialise(pairs.select("term").distinct())
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.split(F.lower("text"), NOT_TERM))).alias("term"))
    own = texts.join(measured_side(asked), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("h")).distinct().count() + (0 if whole else said.count())
    entity = said.groupBy("entity").agg(F.count("*").alias("n_entity"))
    rows = pairs.join(own, "term").join(entity, "entity")
    n_term = F.greatest("n_term", "both")
    mutual = F.log(F.col("both") * F.lit(float(total)) / (n_term * F.col("n_entity")))
    rows = rows.where(F.col("n_entity") < total).select("term", "entity", F.least(F.lit(1.0), mutual / F.log(F.lit(float(total)) / F.col("n_entity"))).alias("disclosure")).where(F.col("disclosure") >= generalise)
    return rows.groupBy("term").agg(F.max_by("entity", F.struct("disclosure", "entity")).alias("entity"), F.max("disclosure").alias("disclosure"))


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, joint: int = MIN_JOINT, whole: bool = False) -> DataFrame:
    """The documents that hold something to sanitise: docs' columns with the sanitised text (and n_chars, if there), and n_entities, n_generalised, n_removed.

    Entities become [KIND]. Of disclosing_terms(), those of a disclosure of `remove` or more are taken out wherever they stand, whatever the case of their letters;
    others become [NUMBER] or [WORD]. Null and empty texts, and documents with nothing to sanitise, aren't in the result; a null doc_id stays null; repeated rows
    are sanitised each. Columns of docs by these three names are replaced. Texts are searched whole.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_entities", "n_generalised", "n_removed")]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    terms = materialise(disclosing_terms(docs, generalise, joint, whole))
    rid, hard, soft, work = (fresh(docs, x) for x in ("gs_row", "gs_hard", "gs_soft", "gs_text"))
    # per text, which of its words are such terms: texts are known by their hash, and only those with a term take part
    asked = measured_side(terms)
    words = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias(rid), F.explode(F.array_distinct(F.split(F.lower("text"), NOT_TERM))).alias("term"))
    held = words.join(asked, "term").groupBy(rid).agg(
        F.collect_set(F.when(F.col("disclosure") >= remove, F.col("term"))).alias(hard), F.collect_set(F.when(F.col("disclosure") < remove, F.col("term"))).alias(soft)
    )
    held = materialise(held)
    marked = docs.withColumn(rid, F.xxhash64("text")).join(measured_side(held), rid, "left")
    marked = marked.where(F.col(hard).isNotNull() | has_entity(F.col("text")))
    empty = F.array().cast("array<string>")
    # split at entities; what stands between them gives up its terms
    gaps, found = F.split("text", ENTITY), F.regexp_extract_all("text", F.lit(f"({ENTITY})"), F.lit(1))
    pattern = lambda c: F.concat(F.lit("(?iu)(?<![\\p{L}\\p{N}])(?:"), F.array_join(F.coalesce(F.col(c), empty), "|"), F.lit(")(?![\\p{L}\\p{N}])"))
    many = lambda c: F.size(F.coalesce(F.col(c), empty)) > 0
    count = lambda text, c: F.when(many(c), F.regexp_count(text, pattern(c))).otherwise(0)
    numeric = lambda a: F.filter(a, lambda w: w.rlike("[0-9]"))
    verbal = lambda a: F.filter(a, lambda w: ~w.rlike("[0-9]"))
    num, wor = fresh(docs, "gs_num"), fresh(docs, "gs_word")
    marked = marked.withColumns({num: numeric(F.coalesce(F.col(soft), empty)), wor: verbal(F.coalesce(F.col(soft), empty))})

    def clean(x: Column) -> Column:
        x = F.when(many(hard), F.regexp_replace(x, pattern(hard), F.lit(""))).otherwise(x)
        x = F.when(many(num), F.regexp_replace(x, pattern(num), F.lit("[NUMBER]"))).otherwise(x)
        return F.when(many(wor), F.regexp_replace(x, pattern(wor), F.lit("[WORD]"))).otherwise(x)

    parts = F.struct(gaps.alias("gaps"), found.alias("found"))
    split = marked.select("*", F.explode(F.array(parts)).alias(work))
    pieces = F.zip_with(F.col(work)["gaps"], F.col(work)["found"], lambda g, x: F.concat(clean(g), F.when(x.isNull(), F.lit("")).otherwise(F.concat(F.lit("["), F.coalesce(_kind(x), F.lit("NUMBER")), F.lit("]")))))
    between = F.array_join(F.col(work)["gaps"], "\n\n")
    new = fresh(docs, "gs_new")
    out = split.select(
        *[F.col(f"`{c}`") for c in own], F.array_join(pieces, "").alias(new),
        F.size(F.col(work)["found"]).alias("n_entities"), (count(between, num) + count(between, wor)).alias("n_generalised"), count(between, hard).alias("n_removed"),
    ).where("n_entities + n_generalised + n_removed > 0")
    changed = {"text": F.col(new), "n_chars": F.length(new).cast("long")}
    return out.select(*[changed.get(c.lower(), F.col(f"`{c}`")).alias(c) for c in own], "n_entities", "n_generalised", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(read_table(spark, sf_dir, "documents", "doc_id", "text"))
