"""Index tables over segments (I01-I17), each keyed by user_id: rows, postings, statistics, names, dates, rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def _by_session(segments: DataFrame) -> DataFrame:
    """segments with __first, the number of the user's segments in earlier sessions, and __number, the session's place. One
    row a session is ordered within a user, not one row a segment, so a user with very many segments is no large group."""
    sessions = segments.groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy("user_id").orderBy("session_id")
    earlier = F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    sessions = sessions.select(F.col("user_id").alias("__u"), F.col("session_id").alias("__s"), earlier.alias("__first"), F.row_number().over(order).alias("__number"))
    return segments.join(sessions, F.expr("user_id <=> __u and session_id <=> __s")).drop("__u", "__s")


def _pos() -> Column:
    order = W.partitionBy("user_id", "session_id").orderBy("seq", "part")
    return (F.col("__first") + F.row_number().over(order) - 1).cast("int").alias("pos")


def positions(segments: DataFrame) -> DataFrame:
    """Pos counts a user's segments from 0 in the order of session, seq and part."""
    return _by_session(segments).select(*segments.columns, _pos())


def index_rows(segments: DataFrame) -> DataFrame:
    """Positions, labels of the sessions in their order of appearance, which is their order, and the indexed
    text; the stored vector is reduced to whether there is one."""
    label = F.concat(F.lit("session "), F.col("__number").cast("string")).alias("session_label")
    rows = _by_session(segments).select(*segments.columns, _pos(), label)
    if "embedding" in rows.columns:
        rows = rows.withColumn("has_vector", F.col("embedding").isNotNull()).drop("embedding")
    return rows.withColumn("index_text", T.index_text(F.col("speaker_name"), F.col("role"), F.col("ts_value"), F.col("text")))


def postings(rows: DataFrame) -> DataFrame:
    """(user_id, pos, dl, term, tf)."""
    d = rows.select("user_id", "pos", T.tokens(F.col("index_text")).alias("t"))
    d = d.select("user_id", "pos", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return d.groupBy("user_id", "pos", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def corpus_stats(rows: DataFrame) -> DataFrame:
    """Rows and mean length per user; rows without a token count."""
    return rows.select("user_id", F.size(T.tokens(F.col("index_text"))).alias("dl")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("dl").alias("avgdl"))


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """Df and idf per user and term; a negative idf becomes a quarter of the mean idf over the user's terms."""
    df = post.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df")).join(stats, "user_id")
    df = df.withColumn("raw_idf", F.ln(F.col("n_rows") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = df.groupBy("user_id").agg(F.avg("raw_idf").alias("mean_idf"))
    df = df.join(mean, "user_id")
    return df.withColumn("idf", F.when(F.col("raw_idf") < 0, C.EPSILON * F.col("mean_idf")).otherwise(F.col("raw_idf"))).drop("raw_idf", "mean_idf")


def names_of_rows(rows: DataFrame) -> DataFrame:
    """(user_id, pos, i, name) in order, the speaker last."""
    d = rows.select("user_id", "pos", T.row_names(F.col("text"), F.col("speaker_name")).alias("n"))
    return d.select("user_id", "pos", F.posexplode("n").alias("i", "name"))


def first_spellings(named: DataFrame) -> DataFrame:
    """Each name of a user once, lower-cased, with its first spelling and its rank of first appearance."""
    first = named.groupBy("user_id", F.lower("name").alias("alias")).agg(F.min(F.struct("pos", "i", "name")).alias("f"))
    order = W.partitionBy("user_id").orderBy("f.pos", "f.i")
    return first.select("user_id", "alias", F.col("f.name").alias("spelling"), F.row_number().over(order).alias("ord"))


def ambiguous_names(spellings: DataFrame) -> DataFrame:
    """(user_id, alias) of names within two or more longer names that are not taken for one person: such a container
    counts if it matches no container before it. Containers are found by an equi-join on their substrings."""
    from_, n = F.sequence(F.lit(1), F.length("alias")), F.length("alias")
    within = F.array_distinct(F.flatten(F.transform(from_, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col("alias"), i, k)))))
    holders = spellings.where("alias <> ''").select("user_id", "ord", F.col("alias").alias("holder"), F.explode(within).alias("alias"))
    found = spellings.select("user_id", "alias").join(holders, ["user_id", "alias"]).where("alias <> holder")
    lists = found.groupBy("user_id", "alias").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("holder").alias("alias")))).alias("c"))
    fresh = F.filter("c", lambda x: ~F.exists(F.filter("c", lambda y: y["ord"] < x["ord"]), lambda y: T.same_person(x["alias"], y["alias"])))
    return lists.where(F.size(fresh) >= 2).select("user_id", "alias")


def alias_groups(named: DataFrame) -> DataFrame:
    """(user_id, alias, canonical). In order of first appearance a name joins the first canonical name that it matches,
    else becomes one; ambiguous names stand alone. The fold runs over the distinct names of one user, whose bigrams are made
    before it."""
    spell = first_spellings(named)
    odd = ambiguous_names(spell).withColumn("odd", F.lit(True))
    d = spell.join(odd, ["user_id", "alias"], "left").withColumn("odd", F.coalesce("odd", F.lit(False)))
    d = d.withColumn("grams", T.bigrams(F.col("spelling")))
    per_user = d.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ord", "alias", "spelling", "odd", "grams"))).alias("names"))

    def step(acc: Column, x: Column) -> Column:
        def joined(match: Column) -> Column:
            target = F.when(x["odd"], x["spelling"]).otherwise(F.coalesce(match, x["spelling"]))
            own = F.struct(*(x[f].alias(f) for f in ("spelling", "alias", "grams")))
            return F.struct(
                F.when(~x["odd"] & match.isNull(), F.concat(acc["canons"], F.array(own))).otherwise(acc["canons"]).alias("canons"),
                F.concat(acc["out"], F.array(F.struct(x["alias"].alias("alias"), target.alias("canonical")))).alias("out"),
            )

        alike = F.filter(acc["canons"], lambda c: T.alike(c["alias"], c["grams"], x["alias"], x["grams"]))
        return T.let(F.get(alike, F.lit(0))["spelling"], joined)

    start = F.struct(F.array().cast("array<struct<spelling:string,alias:string,grams:array<string>>>").alias("canons"), F.array().cast("array<struct<alias:string,canonical:string>>").alias("out"))
    return per_user.select("user_id", F.explode(F.aggregate("names", start, step, lambda acc: acc["out"])).alias("g")).select("user_id", "g.alias", "g.canonical")


def entity_postings(named: DataFrame, groups: DataFrame) -> DataFrame:
    """(user_id, canonical, pos)."""
    return named.withColumn("alias", F.lower("name")).join(groups, ["user_id", "alias"]).select("user_id", "canonical", "pos").distinct()


def date_postings(rows: DataFrame) -> DataFrame:
    """(user_id, day, month, pos) of rows with a time."""
    return rows.where("ts_value is not null").select("user_id", F.date_format("ts_value", "yyyy-MM-dd").alias("day"), F.date_format("ts_value", "yyyy-MM").alias("month"), "pos")


def rule_rows(rows: DataFrame) -> DataFrame:
    """I15."""
    return rows.where("is_rule").select("user_id", "pos")


def version_of(df: DataFrame) -> str:
    """A name for the state of the files that df reads: their number, newest change and bytes."""
    m = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_size").alias("n")).distinct()
    r = m.agg(F.count(F.lit(1)).alias("c"), F.max(F.unix_micros("t")).alias("t"), F.sum("n").alias("n")).first()
    return f"{r['c']}-{r['t']}-{r['n']}"


def _put(table: DataFrame, path: str, name: str) -> None:
    table.sortWithinPartitions("user_id").write.mode("overwrite").parquet(f"{path}/{name}")


def _put_version(spark: SparkSession, path: str, version: str) -> None:
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/version")


@dataclass
class Index:
    """The tables of one version of a store (I17): build once, keep or write them, and share them between searches."""

    rows: DataFrame
    postings: DataFrame
    stats: DataFrame
    terms: DataFrame
    aliases: DataFrame
    entities: DataFrame
    dates: DataFrame
    rules: DataFrame
    vectors: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if v is not None}

    def persist(self) -> Index:
        return Index(**{k: v.persist() for k, v in self.tables().items()})

    def unpersist(self) -> None:
        for v in self.tables().values():
            v.unpersist()

    def write(self, path: str, version: str = "") -> None:
        """Parquet under path, sorted by user within files, so that a search for few users prunes row groups. The version is
        written last: an index whose writing broke off has none."""
        for k, v in self.tables().items():
            _put(v, path, k)
        _put_version(self.rows.sparkSession, path, version)

    @classmethod
    def create(cls, segments: DataFrame, path: str, version: str = "") -> Index:
        """build_index() and write() in one: each table is made of those already written, so texts are tokenized and names are
        found once. Beside the index's tables the folder then holds the names of the rows."""

        def keep(name: str, table: DataFrame) -> DataFrame:
            _put(table, path, name)
            return segments.sparkSession.read.parquet(f"{path}/{name}")

        made = build_index(segments, keep)
        _put_version(segments.sparkSession, path, version)
        return made

    @classmethod
    def stored_version(cls, spark, path: str) -> str | None:
        """The version of the index at path; None where there is no whole one."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version/_SUCCESS")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return spark.read.parquet(f"{path}/version").first()["version"]

    @classmethod
    def current(cls, spark, path: str, version: str, segments: Callable[[], DataFrame], vectors: bool = True) -> Index:
        """The index at path if it has this version, else one built of segments() and written there. An old index is not
        read while it is replaced: each version has a folder of its own."""
        place = f"{path}/{version or 'index'}"
        if cls.stored_version(spark, place) != version:
            cls.create(segments(), place, version)
        return cls.read(spark, place, vectors)

    @classmethod
    def read(cls, spark, path: str, vectors: bool = True) -> Index:
        names = ("rows", "postings", "stats", "terms", "aliases", "entities", "dates", "rules", *(["vectors"] if vectors else []))
        return cls(**{k: spark.read.parquet(f"{path}/{k}") for k in names})


def build_index(segments: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda name, table: table) -> Index:
    """All index tables of a segment table; its embedding column, if any, becomes the vectors table (user_id, pos,
    embedding, norm). keep() gets each table by its name and returns what later tables are made of: the table itself, or the
    same rows written."""
    rows = keep("rows", index_rows(segments))
    post, stats = keep("postings", postings(rows)), keep("stats", corpus_stats(rows))
    terms = keep("terms", term_stats(post, stats))
    named = keep("names", names_of_rows(rows))
    groups = keep("aliases", alias_groups(named))
    entities = keep("entities", entity_postings(named, groups))
    dates, rules = keep("dates", date_postings(rows)), keep("rules", rule_rows(rows))
    vectors = None
    if "embedding" in segments.columns:
        vectors = positions(segments).where("embedding is not null").select("user_id", "pos", "embedding").withColumn("norm", T.norm(F.col("embedding")))
        vectors = keep("vectors", vectors)
    return Index(rows, post, stats, terms, groups, entities, dates, rules, vectors)
