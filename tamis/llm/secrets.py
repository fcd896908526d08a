"""Secret scans with ownership frequency, in DataFrame functions only.

Candidates are found by pattern, with their places in code points: `split` gives the texts between the matches, so the start of a
match is the sum of the lengths before it. Each candidate's value is then counted over the corpus by distinct repositories
(documents, unless a column is named) and owners (sources): a value under EXAMPLE_OWNERS owners or more is a copied example, the
others look live. On top of the base patterns, a random-looking word that has one owner only is a secret of kind `owned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.flat import free_name
from tamis.llm.linking import salted_join
from tamis.session import cut_lineage

#: Base kinds in the order of ties; pattern, group of the value, least length of the value.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 characters or more: a match takes its whole run, so a shorter one holds no other
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 characters or more
KINDS = ("assign", "access", "hex", "owned")
#: What a text must hold for a pattern to be worth its cost: the same matches with the least length.
_MAY = {"assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
WORD = r"[A-Za-z0-9_-]{20,}"
_MAY_WORD = r"[A-Za-z0-9_-]{20}"
EXAMPLE_OWNERS = 3
OWNED_LENGTH = (20, 128)
OWNED_DIGITS = 3
OWNED_CHARACTERS = 10


def _runs(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>> of all matches, leftmost and not overlapping."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.zip_with(F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), whole, lambda before, hit: F.struct(
        F.length(before).alias("skip"), F.length(hit).alias("size"))), value, lambda s, v: F.struct(
            s["skip"].alias("skip"), s["size"].alias("size"), v.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state, m):
        begin = state["at"] + m["skip"]
        return F.struct((begin + m["size"]).alias("at"), F.concat(state["out"], F.array(F.struct(
            begin.alias("start"), (begin + m["size"]).alias("end"), m["value"].alias("value")))).alias("out"))

    return F.aggregate(steps, start, step, lambda state: state["out"])


def _kind(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    hits = F.transform(F.filter(_runs(text, pattern, group), lambda m: F.length(m["value"]) >= least), lambda m: F.struct(
        m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(text.rlike(_MAY[KINDS[number]]), hits).otherwise(none)


def _random_words(text: Column, base: Column) -> Column:
    """Words of letters, digits, _ and - that look random and don't touch a base span."""
    def fits(m):
        word = m["value"]
        return (F.length(word).between(*OWNED_LENGTH) & (F.length(F.regexp_replace(word, "[^0-9]", "")) >= OWNED_DIGITS)
                & word.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(word, ""))) >= OWNED_CHARACTERS)
                & ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

    hits = F.transform(F.filter(_runs(text, WORD, 0), fits), lambda m: F.struct(
        m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(text.rlike(_MAY_WORD), hits).otherwise(none)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """(doc_id, row, owner, repository, base, more): the spans of every text. `row` is a digest of id and text for texts with spans, so
    that equal rows are told apart from others with the same id; null for the rest. A null text is empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(owner).cast("string").alias("owner"),
                       F.col(repository or doc_id).cast("string").alias("repository"))
    t = F.col("text")
    base = rows.withColumn("base", F.sort_array(F.concat(_kind(t, 0, ASSIGN, 1, 8), _kind(t, 1, ACCESS, 0, 16), _kind(t, 2, HEX, 0, 32))))
    both = base.withColumn("more", _random_words(t, F.col("base")))
    row = F.when(F.size("base") + F.size("more") > 0, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), t)))
    return both.select("doc_id", row.alias("row"), "owner", "repository", "base", "more")


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories): in how many distinct owners and repositories each candidate value occurs. Repeats are combined
    before every shuffle, so a value of a third of all rows is no hot task. A null owner or repository counts as one of its own."""
    spans = found.where("row is not null").select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias(
        "repository"), F.explode(F.concat("base", "more")).alias("s")).select("owner", "repository", F.col("s.value").alias("value"))
    pairs = spans.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None,
         example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, row, secrets): one row for each row of `docs`; `secrets` is array<struct<start, kind, end, value, owners, repositories,
    live>> by start, then kind: all base spans, and the random-looking words with a single owner. `live`: fewer than
    `example_owners` owners. Null or empty texts have none. Extra columns are left out."""
    found = cut_lineage(candidates(docs, doc_id, text, owner, repository))
    spans = found.where("row is not null").select("row", F.explode(F.concat("base", "more")).alias("s")).select(
        "row", "s.start", "s.kind", "s.end", "s.value")
    counted = salted_join(spans, ownership(found), "value", "row")
    kept = counted.where("kind < 3 or owners = 1").select("row", F.struct("start", "kind", "end", "value", "owners", "repositories", (
        F.col("owners") < example_owners).alias("live")).alias("s"))
    by_row = kept.groupBy("row").agg(F.sort_array(F.collect_set("s")).alias("secrets"))  # the spans of one text
    none = F.array().cast(by_row.schema["secrets"].dataType)
    some = found.where("row is not null").select("doc_id", "row").join(by_row, "row", "left").select(
        "doc_id", "row", F.coalesce("secrets", none).alias("secrets"))
    return some.unionByName(found.where("row is null").select("doc_id", "row", none.alias("secrets")))  # most rows: not through the join


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast(
        "string"), s["end"].cast("string"))), ",")


def span_report(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live) from the result of `scan`."""
    def count(test):
        return F.size(F.filter("secrets", test)).cast("long")

    def of_kind(k):
        return count(lambda s: s["kind"] == k)

    return found.select(
        "doc_id", *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_named(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _named(F.col("secrets")).alias("spans"),
        of_kind(3).alias("n_owned"), count(lambda s: s["live"]).alias("n_live"))


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """`text` with the live secrets replaced by `mark`; overlapping spans become one mark."""
    live = F.filter(secrets, lambda s: s["live"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        begin, end = s["start"].cast("int"), s["end"].cast("int")
        inside = begin < state["at"]
        return F.struct(F.greatest(state["at"], end).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(
            state["out"], F.substring(text, state["at"] + 1, begin - state["at"]), F.lit(mark))).alias("out"))

    return F.when(F.size(live) == 0, text).otherwise(F.aggregate(live, start, step, lambda s: F.concat(
        s["out"], F.substring(text, s["at"] + 1, F.length(text)))))


def without_secrets(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with the live secrets of `found` (from `scan`) marked over in the text. All rows stay; copied examples stay as they are."""
    row, key, spans = (free_name(docs.columns, n) for n in ("_row", "_key", "_spans"))
    live = found.where(F.exists("secrets", lambda s: s["live"])).select(F.col("row").alias(key), F.col("secrets").alias(spans)).dropDuplicates([key])
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.col(text)))
    rows = docs.withColumn(row, digest).join(live, F.col(row) == F.col(key), "left")
    return rows.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col(spans), mark))).select(docs.columns)
