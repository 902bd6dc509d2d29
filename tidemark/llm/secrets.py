"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the matches of three base patterns, and opaque runs of letters and digits. Each is known by
the SHA-256 of its value alone. Over the whole corpus the hashes are counted by distinct owners and distinct
repositories: a value that many owners hold is a copied example, one that few hold looks like somebody's live
credential. Base matches are always reported and judged by their owners alone; an opaque run is reported (kind
``opaque``) only if it looks live, has enough different characters and overlaps no base match.

The table of documents has no repository column: its source stands for the owner, and source with lang
for the repository; both are parameters. Positions count code points, the end is exclusive, and a span
covers the whole match. A null text counts as empty. Nulls in doc_id stay rows of their own, a null owner
or repository counts as one of its kind; repeated rows are reported each, and count once per owner. No
spans give the SHA-256 of the empty string and an empty ``spans``. Extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, table

# The base patterns and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORD = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
OPAQUE = "[A-Za-z0-9+/_-]{20,}"
LEAST_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "opaque")

MARK, INSTEAD = "", ""
SPAN = "struct<start:int,kind:int,end:int,hash:string,varied:boolean>"
EXAMPLE_OWNERS = 3
LEAST_VARIED = 8  # distinct characters of an opaque run
REDACTED = "[SECRET]"
STRETCH = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not once an element of the arrays in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(array: Column) -> Column:
    """An array in stretches of ``STRETCH``, so that no step copies all that was found before."""
    stretches = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(array) - 1) / STRETCH).cast("int")))
    return F.transform(stretches, lambda c: F.slice(array, c * STRETCH + 1, F.lit(STRETCH)))


def _spans(text: Column, pattern: str, kind: int, wanted, value) -> Column:
    """Matches as an array of spans: the matches are marked, the text split at the marks, lengths summed.

    Every second piece is a match, also within a stretch. The work grows with the pieces, but for a
    2 * STRETCH'th part of their square.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        secret = value(piece)
        varied = F.size(F.array_distinct(F.split(secret, ""))) >= LEAST_VARIED
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(secret, 256).alias("hash"), varied.alias("varied"))
        found = F.when(acc["match"] & wanted(piece), F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), (~acc["match"]).alias("match"), found.alias("found"))

    def of_stretch(pieces: Column, at: Column) -> Column:
        return F.aggregate(pieces, F.struct(at.alias("at"), F.lit(False).alias("match"), none.alias("found")), step)["found"]

    def of_stretches(stretches: Column) -> Column:
        length = lambda pieces: F.aggregate(pieces, F.lit(0), lambda n, p: n + F.length(p))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = F.aggregate(stretches, start, lambda acc, s: F.struct((acc["at"] + length(s)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))
        return F.flatten(F.zip_with(stretches, starts["all"], of_stretch))

    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    return _let(_let(pieces, _cut), of_stretches)


def candidates(text: Column) -> Column:
    """Array of candidate spans of all kinds, in no order."""
    whole, always = (lambda p: p), (lambda p: F.lit(True))
    assigned = lambda p: F.regexp_extract(p, ASSIGN, 2)
    mixed = lambda p: p.rlike("[0-9]") & p.rlike("[A-Z]") & p.rlike("[a-z]")
    none = F.array().cast(f"array<{SPAN}>")

    def of(text: Column) -> Column:
        return F.concat(
            F.when(text.rlike(KEYWORD), _spans(text, ASSIGN, 0, lambda p: F.length(assigned(p)) >= LEAST_ASSIGNED, assigned)).otherwise(none),
            F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, always, whole)).otherwise(none),
            F.when(text.rlike(HEX), _spans(text, HEX, 2, always, whole)).otherwise(none),
            F.when(text.rlike(OPAQUE), _spans(text, OPAQUE, 3, mixed, whole)).otherwise(none),
        )

    text = F.coalesce(text, F.lit(""))
    return _let(F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit(INSTEAD))).otherwise(text), of)


def without_overlaps(found: Column) -> Column:
    """The spans in order of start, then kind; opaque ones that touch a base match go."""
    least = lambda spans, field: F.array_min(F.transform(spans, lambda s: s[field]))
    most = lambda spans, field: F.array_max(F.transform(spans, lambda s: s[field]))
    bounded = lambda spans: F.struct(spans.alias("spans"), least(spans, "start").alias("start"), most(spans, "end").alias("end"))
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def free(found: Column, base: Column) -> Column:
        hit = lambda s: F.exists(base, lambda stretch: touch(stretch, s) & F.exists(stretch["spans"], lambda b: touch(b, s)))
        return F.array_sort(F.filter(found, lambda s: (s["kind"] < 3) | ~hit(s)))

    def of(found: Column) -> Column:
        base = _let(F.array_sort(F.filter(found, lambda s: s["kind"] < 3)), lambda base: F.transform(_cut(base), bounded))
        return F.when(F.size(found) > 0, _let(base, lambda base: free(found, base))).otherwise(found)

    return _let(found, of)


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """By hash: in how many distinct owners and repositories it occurs.

    Two steps of aggregation: one value may make up a third of all candidates.
    """
    each = found.select(F.explode("found.hash").alias("hash"), owner, repository).groupBy("hash", owner, repository).agg(F.lit(1).alias("one"))
    owners = each.groupBy("hash", owner).agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def judge(found: DataFrame, owner: str = "owner", repository: str = "repository", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Rows (row, spans) of the rows of ``found`` (row, found, owner, repository) with candidates.

    Each span gets ``live``: few owners have it, and if it is an opaque run, it is varied.
    """
    some = found.where(F.size("found") > 0)
    # Written first: Spark then splits the tasks of a value that makes up much of all candidates.
    counted = stored(ownership(some, owner, repository), "ownership")
    each = some.select("row", F.explode("found").alias("s")).select("row", "s", F.col("s.hash").alias("hash")).join(counted, "hash")
    live = (F.col("owners") < example_owners) & ((F.col("s.kind") < 3) | F.col("s.varied"))
    span = F.struct("s.start", "s.kind", "s.end", live.alias("live"), "owners", "repositories")
    each = each.where((F.col("s.kind") < 3) | live)
    return each.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """A row per document: its base spans and the spans that the method adds.

    The texts are scanned once; what was found is written to the shared folder and read by the counts.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = documents.select("doc_id", owner.alias("owner"), repository.alias("repository"), without_overlaps(candidates(F.col("text"))).alias("found"))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    judged = found.select("row", "doc_id").join(judge(found), "row", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,repositories:bigint>>"))
    count = lambda test: F.size(F.filter(spans, test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    return judged.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["owners"] >= EXAMPLE_OWNERS).alias("n_example"),
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def redact(documents: DataFrame, mask: str = REDACTED) -> DataFrame:
    """``documents`` with every live-looking secret replaced by ``mask``; copied examples stay.

    Only the few texts with candidates move; the others pass by. n_chars follows the new text; all other columns,
    whatever their names, stay as they are. Null and empty texts stay; repeated rows are masked each; an empty
    table gives no rows.
    """
    of = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    has = F.size(candidates(F.col("text"))) > 0
    dirty = documents.where(has).select(of, without_overlaps(candidates(F.col("text"))).alias("found"), F.monotonically_increasing_id().alias("row"))
    dirty = stored(dirty.withColumn("owner", F.col("doc.source")).withColumn("repository", F.concat_ws("/", "doc.source", "doc.lang")), "with-candidates")
    judged = dirty.select("doc", "row").join(judge(dirty.select("row", "found", "owner", "repository")), "row", "left")
    text = F.col("doc.text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(before, F.lit(mask)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    live = F.filter("spans", lambda s: s["live"])
    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    changed = F.coalesce(F.size(live) > 0, F.lit(False))
    judged = judged.withColumn("new", F.when(changed, F.aggregate(live, start, step, rest)).otherwise(text))
    doc = F.col("doc").withField("text", F.col("new"))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        doc = doc.withField("n_chars", F.when(changed, F.length("new").cast(kind)).otherwise(F.col("doc.n_chars")))
    return documents.where(~has).unionByName(judged.select(doc.alias("doc")).select("doc.*"))


def op10(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, judged by who else holds them."""
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_secret_ownership": op10}
