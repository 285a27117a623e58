"""Search and ranking over entities, relations and flows."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..functions.text import RESOLUTION, Scorer, normalize_text, score_text, token_match, tokens


def any_of(columns: list[str], test) -> Column:
    """Whether test holds for the upper case of one of the columns; null columns don't count."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(test(F.upper(F.col(c))), F.lit(False))
    return out


def entity_score(term: str, columns: list[str]) -> Column:
    """100 if id, name or label is the term, 70 if name, label, parent or type begins with it, 40 if any column holds it."""
    have = lambda names: [c for c in names if c in columns]
    t = F.lit(term.strip().upper())
    inside = any_of(have(["id", "name", "label", "parent", "parentType"]), lambda c: F.contains(c, t))
    if "files" in columns:
        inside = inside | F.coalesce(F.exists("files", lambda f: F.contains(F.upper(f), t)), F.lit(False))
    return F.when(any_of(have(["id", "name", "label"]), lambda c: c == t), 100).when(any_of(have(["name", "label", "parent", "type"]), lambda c: F.startswith(c, t)), 70).when(inside, 40).otherwise(0)


def entities(df: DataFrame, term: str, kind: str | None = None) -> DataFrame:
    """Matching entities with their score; nothing for an empty term."""
    if not term.strip():
        return df.limit(0).withColumn("score", F.lit(0))
    df = df.filter(F.col("type") == kind.lower()) if kind else df
    return df.withColumn("score", entity_score(term, df.columns)).filter("score > 0")


def get_entity(df: DataFrame, key: str) -> DataFrame:
    """The entity of this id, else the first (by id) of this name."""
    hit = df.filter((F.col("id") == key) | (F.upper("name") == key.upper()))
    return hit.orderBy((F.col("id") != key).cast("int"), "id").limit(1)


def relations(df: DataFrame, term: str) -> DataFrame:
    """Relations with the term in a label or id of an end."""
    t = F.lit(term.strip().upper())
    return df.filter(any_of([c for c in ("from_label", "to_label", "from_id", "to_id") if c in df.columns], lambda c: F.contains(c, t)))


def flows(df: DataFrame, term: str, kind: str | None = None) -> DataFrame:
    """Flows (entry_id, entry_label, entry_name, summary, subject_ids, tokens) by the sum of 100 exact, 35 prefix, 25 token and 15 inside."""
    t = F.lit(term.strip().upper())
    df = df.filter(F.col("type") == kind.lower()) if kind else df
    texts = F.transform(F.filter(F.concat(F.array("entry_label", "entry_name", "summary"), "subject_ids"), lambda x: x.isNotNull()), lambda x: F.upper(x))
    score = (
        F.when(any_of(["entry_label", "entry_name", "entry_id"], lambda c: c == t), 100).otherwise(0)
        + F.when(F.exists(texts, lambda x: F.startswith(x, t)), 35).otherwise(0)
        + F.when(F.array_contains("tokens", t), 25).otherwise(0)
        + F.when(F.exists(texts, lambda x: F.contains(x, t)), 15).otherwise(0)
    )
    return df.withColumn("score", score).filter("score > 0")


def related_flows(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Flows that have one of the ids (id) as a subject, with how many and which."""
    met = df.select("entry_id", F.explode("subject_ids").alias("id")).join(ids.select("id").distinct(), "id", "left_semi")
    return df.join(met.groupBy("entry_id").agg(F.count("*").alias("n_matched"), F.array_sort(F.collect_set("id")).alias("matched_ids")), "entry_id")


def fuzzy(df: DataFrame, query: str, values: list[str], scorer: Scorer = RESOLUTION) -> DataFrame:
    return df.withColumn("score", score_text(F.lit(query), F.array(*[F.col(v) for v in values]), scorer)).filter("score > 0")


# What a type adds to the score of an entity.
TYPE_WEIGHT = {"job": 30, "program": 28, "screen": 26, "procedure": 22, "table": 20, "dataset": 16, "step": 14, "class": 10, "module": 10, "component": 8, "subroutine": 6, "copybook": 6, "column": 2, "field": 2, "control": 1}


def type_weight(kind: Column) -> Column:
    out = F.lit(0)
    for name, weight in TYPE_WEIGHT.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def rank_seed(df: DataFrame, query: str, scorer: Scorer = RESOLUTION, weak_penalty: int = 28) -> DataFrame:
    """Entities by text score and type weight, less a penalty for inferred or unsure ones; only with a text score."""
    scored = fuzzy(df, query, [c for c in ("name", "label", "description") if c in df.columns], scorer)
    weak = F.coalesce("inferred", F.lit(False)) | (F.coalesce("confidence", F.lit(0.0)) < 0.5)
    return scored.withColumn("score", F.col("score") + type_weight(F.col("type")) - F.when(weak, weak_penalty).otherwise(0))


def score_window(df: DataFrame, delta: int = 18, most: int = 6) -> DataFrame:
    """The best rows: at most so many, and no more than delta under the best."""
    top = cut(df.orderBy(F.desc("score"), "id").limit(most))  # the limit is the feature
    best = top.agg(F.max("score").alias("best"))
    return top.join(F.broadcast(best), F.col("score") >= F.col("best") - delta).drop("best")  # one row


def token_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """(token, id): inverted index over words of the columns."""
    return df.select("id", F.explode(F.array_distinct(F.flatten(F.array(*[tokens(F.col(c), 1, ("",)) for c in columns])))).alias("token"))


def token_search(df: DataFrame, index: DataFrame, aliases: DataFrame, term: str, enough: int = 5) -> DataFrame:
    """(id, tier): names equal to the term (1) and aliases (2), then words that begin with it (3), then names that hold it (4); a later tier only while the earlier ones have fewer than enough."""
    t = term.strip().upper()
    tiers = [
        df.filter(F.upper("name") == t).select("id"),
        aliases.filter(F.upper("alias") == t).select(F.col("canonical_id").alias("id")),
        index.filter(F.startswith("token", F.trim(normalize_text(F.lit(t))))).select("id"),
        df.filter(F.contains(F.upper("name"), F.lit(t))).select("id"),
    ]
    found = cut(tiers[0].withColumn("tier", F.lit(1)).union(tiers[1].withColumn("tier", F.lit(2))).groupBy("id").agg(F.min("tier").alias("tier")))
    for k in (3, 4):
        if found.limit(enough).count() < enough:
            found = cut(found.unionByName(tiers[k - 1].distinct().join(found, "id", "left_anti").withColumn("tier", F.lit(k))))
    return found


# --- stored index ------------------------------------------------------------------------------------

#: Bytes of a row group of the index files: a prefix reads only the groups whose range of tokens it meets.
GROUP_BYTES = 1 << 20
GRAM = 2


def normal(text: str) -> str:
    """Upper case without marks, as normalize_text has it."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).upper()


def grams_of(token: Column) -> Column:
    """Distinct runs of GRAM letters of a token with its ends marked."""
    marked = F.concat(F.lit("^"), token, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - (GRAM - 1)), lambda i: F.substr(marked, i, F.lit(GRAM))))


def write_index(df: DataFrame, columns: list[str], folder: str, parts: int | None = None) -> None:
    """Writes the inverted index of df (id, columns): postings (token, id) in ranges of tokens, so that a prefix prunes files and row groups; words (token, length); and grams (gram, length, token) in ranges of letter pairs."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = {"parquet.block.size": str(GROUP_BYTES)}
    post = token_index(df, columns).filter("token <> ''").distinct()
    post.repartitionByRange(n, "token", "id").sortWithinPartitions("token", "id").write.options(**sized).parquet(f"{folder}/postings")
    words = df.sparkSession.read.parquet(f"{folder}/postings").select("token").distinct().select("token", F.length("token").alias("length"))
    words.repartitionByRange(n, "length", "token").sortWithinPartitions("length", "token").write.options(**sized).parquet(f"{folder}/words")
    near = df.sparkSession.read.parquet(f"{folder}/words").select(F.explode(grams_of(F.col("token"))).alias("gram"), "length", "token")
    near.repartitionByRange(n, "gram", "length", "token").sortWithinPartitions("gram", "length", "token").write.options(**sized).parquet(f"{folder}/grams")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    words: DataFrame
    grams: DataFrame


def read_index(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{t}") for t in ("postings", "words", "grams")])


def by_prefix(index: Index, term: str) -> DataFrame:
    """(id) of the entries with a token that begins with the term; the range of tokens reaches the scan."""
    return index.postings.filter(F.startswith("token", F.lit(normal(term)))).select("id").distinct()


def like_tokens(index: Index, asked: str, scorer: Scorer = RESOLUTION) -> DataFrame:
    """(token) of all indexed tokens that match the asked word: equal, one inside the other, or as similar as the scorer wants.

    An edit changes two letter pairs at most, so a token that is similar shares a pair with the word where the word has more distinct pairs than twice
    the edits that its similarity allows; such tokens are read by pair and length, others by length. The edit distance is taken of these only.
    """
    m, reach = len(asked), 1 - scorer.least_similarity
    low, high = int(m * scorer.least_similarity), int(m / scorer.least_similarity) + 1
    pairs = sorted({f"^{asked}$"[i : i + GRAM] for i in range(m + 3 - GRAM)})
    edits = int(reach * high + 1e-9)
    near = (F.col("length") >= low) & (F.col("length") <= high)
    similar = index.grams.filter(F.col("gram").isin(pairs) & near) if len(pairs) > 2 * edits else index.words.filter(near)
    inside = index.words.filter(F.contains("token", F.lit(asked)) | F.contains(F.lit(asked), F.col("token")))
    return inside.select("token").union(similar.select("token")).distinct().filter(token_match(F.lit(asked), F.col("token"), scorer))


def fuzzy_indexed(df: DataFrame, index: Index, query: str, columns: list[str], scorer: Scorer = RESOLUTION) -> DataFrame:
    """fuzzy() by way of a stored index of the same columns: only rows with a token like a word of the query's are scored, and rows whose letters without blanks hold those of the query or lie in them.

    Where letters run over the ends of words, one of the words lies in the query, or holds the first or the last half of it at its end or start.
    """
    words = [w for w in re.split("[^A-Z0-9]+", normal(query)) if w]
    asked, bare = [w for w in words if len(w) >= 3 and w not in scorer.stop], "".join(words)
    if not asked:
        return df.limit(0).withColumn("score", F.lit(0))
    found = reduce(lambda a, b: a.union(b), [like_tokens(index, w, scorer) for w in asked])
    halves = [F.endswith("token", F.lit(bare[:k])) | F.startswith("token", F.lit(bare[-k:])) for k in range(-(-len(bare) // 2), len(bare) + 1)]
    across = index.words.filter(reduce(lambda a, b: a | b, [F.contains(F.lit(bare), F.col("token")), F.contains("token", F.lit(bare)), *halves])).select("token")
    ids = index.postings.join(found.union(across).distinct(), "token", "left_semi").select("id").distinct()
    return fuzzy(df.join(ids, "id", "left_semi"), query, columns, scorer)


def domain_pack(values: DataFrame, terms: list[str], least: int = 3) -> DataFrame:
    """(n_terms, special): how many terms occur anywhere in values (value), and whether they are enough for the special pack."""
    text = normalize_text(F.col("value"))
    hit = [F.max(F.when(F.contains(text, F.lit(t)), 1).otherwise(0)) for t in terms]
    total = hit[0]
    for h in hit[1:]:
        total = total + h
    return values.agg(F.coalesce(total, F.lit(0)).alias("n_terms")).withColumn("special", F.col("n_terms") >= least)


def resolve(df: DataFrame, flows_: DataFrame, query: str, strong: int = 100, least: int = 40) -> DataFrame:
    """(id, category, score, status): the best entity or flow for a query. A flow goes first if the best entity is weak and within 18, or if it leads by more than 12; status is resolved, weak or blocked."""
    e = rank_seed(df, query).select("id", F.lit("entity").alias("category"), "score", F.col("type").isin("step", "field", "column", "table", "control", "paragraph").alias("weak")).orderBy(F.desc("score"), "id").limit(1)
    f = fuzzy(flows_, query, ["entry_label", "entry_name", "summary"]).select(F.col("entry_id").alias("id"), F.lit("flow").alias("category"), (F.col("score") + F.least(F.lit(40), F.size("programs") * 4 + F.size("data_objects") * 2)).alias("score"), F.lit(False).alias("weak")).orderBy(F.desc("score"), "id").limit(1)
    both = cut(e.union(f))  # two rows at most
    best = both.agg(F.max(F.when(F.col("category") == "entity", F.col("score"))).alias("e"), F.max(F.when(F.col("category") == "flow", F.col("score"))).alias("f"), F.max(F.when(F.col("category") == "entity", F.col("weak"))).alias("w"))
    pick = F.when(F.col("e").isNull() | (F.col("f") > F.col("e") + 12) | (F.col("w") & (F.col("f") >= F.col("e") - 18)), "flow").otherwise("entity")
    out = both.join(F.broadcast(best.select(pick.alias("category"))), "category")  # one row
    return out.select("id", "category", "score", F.when(F.col("score") < least, "blocked").when(F.col("weak") | (F.col("score") < strong), "weak").otherwise("resolved").alias("status"))
