"""Secret scan with corpus-wide ownership frequency.

Three base kinds are found by pattern. A fourth, ``opaque`` (long mixed runs without any context), is
only a candidate: its value counts as a secret when the whole corpus shows it with few owners and in few
repositories, as a live credential would be; a value that several owners hold, or that one owner holds all over, is a
copied example. Every candidate is hashed and counted by distinct repositories and owners, where equal whole texts
are one repository; base spans stay whatever the count says. ``LIVE_OWNERS`` and ``LIVE_REPOSITORIES`` are the most
that a live value has.

All steps are DataFrame functions. Positions come from the lengths of the text between the matches
and of the matches, added up per document and kind; lengths count code points.

Defined cases: a null text is empty and has no spans; a null owner is one owner of its own; repeated
rows are scanned each; spans of different kinds may overlap, spans of one kind never do, and those that start at one place
are listed by kind; very long texts are scanned whole; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clientlens.llm.common import OWN, content, documents, written


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value, its least length, and a cheap test that every match passes."""
    name: str
    pattern: str
    group: int
    least: int
    hint: str
    base: bool = True


KEYWORDS = "password|passwd|secret|token|api_?key"
KINDS = (
    Kind("assign", r"((?i:" + KEYWORDS + r"))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, "(?i)passw|secret|token|api_?key"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
    Kind("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}", 0, 32, "[A-Za-z0-9+/_-]{32}", base=False),
)
NAMES = tuple(k.name for k in KINDS)
#: Owners and repositories (distinct texts) that show a live value at most.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 16


def _by_kind(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("kind")]


def _maybe(kind: Kind) -> Column:
    """Whether the text can have a match at all; it spares most texts the full pattern."""
    text = F.col("text")
    if kind.name == "assign":
        low = F.lower(text)
        return low.contains("passw") | low.contains("secret") | low.contains("token") | (low.contains("api") & low.contains("key"))
    return text.contains(kind.hint) if kind.hint.isalnum() else text.rlike(kind.hint)


def _found(kind: Kind) -> Column:
    """Matches in order as (kind, i, gap before the match, its length, its value)."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    values = F.regexp_extract_all("text", pattern, F.lit(kind.group)) if kind.group else matches
    gaps = F.transform(F.split("text", kind.pattern, -1), F.length)
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value")), lambda x, i: F.struct(
        F.lit(kind.name).alias("kind"), i.alias("i"), x["gap"].alias("gap"), F.length(x["match"]).alias("n"), x["value"].alias("value")))
    found = F.filter(zipped, lambda x: x["n"].isNotNull())
    return F.when(_maybe(kind), found)


def _repository() -> Column:
    """Names the document's text, so that copies of a whole text are one."""
    return F.sha2(F.col("text").cast("binary"), 256).alias("repository")


def _candidates(scanned: DataFrame) -> DataFrame:
    """One row per match that is long enough: row, owner, repository, kind, start, end, value hash."""
    each = scanned.where(F.size("found") > 0).select("row", "owner", "repository", F.inline("found"))
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    least = _by_kind({k.name: k.least for k in KINDS})
    mixed = (F.col("kind") != "opaque") | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]"))
    return (each.withColumn("end", end).where((F.length("value") >= least) & mixed)
            .select("row", "owner", "repository", "kind", (F.col("end") - F.col("n")).alias("start"), "end", F.sha2(F.col("value").cast("binary"), 256).alias("secret")))


def ownership(candidates: DataFrame, repository: str = "row") -> DataFrame:
    """Per candidate hash: distinct repositories (of each owner) and owners. Rows are made distinct before each count."""
    pairs = candidates.select("secret", "owner", repository).groupBy("secret", "owner", repository).count()
    owners = pairs.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("secret").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def _listed(condition: Column) -> Column:
    spans = F.array_sort(F.filter("spans", lambda x: condition(x)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", owner: str = "source", live_owners: int = LIVE_OWNERS,
         live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """One row per document: row, doc_id, counts, spans (all, as structs) and their digests.

    ``live_owners``, ``live_repositories``: a value with so many owners and in so many distinct texts at most counts as live.
    """
    found = F.concat(*[F.coalesce(_found(k), F.array().cast("array<struct<kind:string,i:int,gap:int,n:int,value:string>>")) for k in KINDS])
    scanned = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"),
                                  content(text).alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
                      .select("row", "doc_id", "owner", _repository(), found.alias("found")), "scanned")
    return _spans(scanned, live_owners, live_repositories)


def _spans(scanned: DataFrame, live_owners: int, live_repositories: int) -> DataFrame:
    candidates = written(_candidates(scanned), "candidates")
    judged = candidates.join(ownership(candidates, "repository"), "secret").withColumn(
        "live", (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories))
    base = F.col("kind").isin([k.name for k in KINDS if k.base])
    spans = judged.where(base | F.col("live")).groupBy("row").agg(
        F.collect_list(F.struct("start", _by_kind({n: i for i, n in enumerate(NAMES)}).alias("order"), "kind", "end", "live")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint,live:boolean>>")
    names = [k.name for k in KINDS if k.base]

    def n(test) -> Column:
        return F.size(F.filter("spans", lambda x: test(x))).cast("bigint")

    def of(name: str):
        return lambda x: x["kind"] == name

    return (scanned.select("row", "doc_id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))
            .select("row", "doc_id", *[n(of(k)).alias(f"n_{k}") for k in names],
                    F.sha2(_listed(lambda x: x["kind"].isin(names)).cast("binary"), 256).alias("base_sha256"),
                    _listed(lambda x: F.lit(True)).alias("listed"), n(lambda x: x["live"]).alias("n_live"), "spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", id_column: str = "doc_id", text: str = "text", owner: str = "source",
             length: str | None = "n_chars", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one mark.

    The texts are staged once with a row number, so that the spans of repeated rows go to their own row.
    ``length``: the column that holds the text's length, set anew where a text changes.
    """
    row = f"{OWN}row"
    staged = written(docs.withColumn(row, F.monotonically_increasing_id()), "secret-docs")
    found = F.concat(*[F.coalesce(_found(k), F.array().cast("array<struct<kind:string,i:int,gap:int,n:int,value:string>>")) for k in KINDS])
    scanned = written(staged.select(F.col(row).alias("row"), F.col(id_column).alias("doc_id"), content(text).alias("text"),
                                    F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
                      .select("row", "doc_id", "owner", _repository(), found.alias("found")), "scanned")
    spans = _spans(scanned, live_owners, live_repositories).where(F.size("spans") > 0).select(
        F.col("row").alias(row), F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).alias(f"{OWN}spans"))
    body = F.col(text)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def take(state: Column, span: Column) -> Column:
        gap = F.substring(body, state["at"].cast("int") + 1, (span["start"] - state["at"]).cast("int"))
        return F.when(span["start"] >= state["at"], F.struct(
            F.concat(state["done"], gap, F.lit(mark)).alias("done"), span["end"].alias("at"))).otherwise(
            F.struct(state["done"].alias("done"), F.greatest(state["at"], span["end"]).alias("at")))

    changed = F.aggregate(f"{OWN}spans", start, take, lambda s: F.concat(s["done"], F.substring(body, s["at"].cast("int") + 1, 2**31 - 1)))
    out = staged.join(spans, row, "left").withColumn(text, F.when(F.col(f"{OWN}spans").isNull(), body).otherwise(changed))
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(f"{OWN}spans").isNull(), F.col(length)).otherwise(F.length(text).cast(dict(docs.dtypes)[length])))
    return out.select(*docs.columns)


def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of the whole table; the owner is the document's source."""
    return scan(documents(spark, folder)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("listed").alias("spans"), "n_live")
