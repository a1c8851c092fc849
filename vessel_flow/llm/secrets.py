"""Secret scan with corpus-wide ownership frequency, built-in functions only.

Patterns give candidate spans per row.  The hashes of the candidates' values
are then counted over the whole corpus by distinct repository and owner: a
value that many owners hold is a copied example, one that a single owner holds
and that looks random is a live credential.

Row-local scanning, one small exchange for the frequencies (partial
aggregates, so a value in a third of all rows is pre-aggregated) and one join
of narrow candidate rows, which AQE splits where a value is hot.

Defined cases: null and empty texts have no spans; rows equal in id and text
share a result; a null owner or repository counts as one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .spans import holds_any, let, places

#: A private key runs to its END line; where that is missing or prose comes before it, through the lines of base64 after
#: its header.
_B64 = r"(?:\s|\\[nrt]|[\"'+,#*>])*+[A-Za-z0-9+/=]"
_PEM = (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
        r"(?:(?:(?!-----|[a-z]{1,20} [a-z]{1,20} [a-z]{1,20} [a-z]{1,20} )[\s\S])*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
        rf"|(?:(?:\s|\\[nr])*+(?:Proc-Type|DEK-Info): [A-Za-z0-9,-]*+)*+(?:{_B64}{{16,}}+)++(?:{_B64}++\s*+\z)?|)")

#: kind, pattern, group of the value, least characters of it, words of which one must be there (lower case).
#: The first three are the base kinds; a hex match is a maximal run, so its least length can stand in the pattern.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
     ["password", "passwd", "secret", "token", "apikey", "api_key"]),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, ["akia"]),
    ("hex", r"[0-9a-f]{32,}", 0, 32, []),
    ("github", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]),
    ("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ["xox"]),
    ("google", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}", 0, 39, ["aiza"]),
    ("stripe", r"(?<![A-Za-z0-9])[rs]k_live_[0-9a-zA-Z]{16,}", 0, 24, ["k_live_"]),
    ("jwt", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, ["eyj"]),
    ("pem", _PEM, 0, 27, ["private key-----"]),
]
BASE_KINDS = 3
#: A value held by at least this many owners, or repositories, is a copied example.
COPIED_OWNERS = 3
COPIED_REPOS = 5
EXAMPLE_WORDS = ["example", "changeme", "placeholder", "password", "xxxx", "dummy", "your"]

_SPAN = "struct<s:int,k:int,e:int,h:bigint,odd:boolean>"


def _value(kind: str, span: Column) -> Column:
    """What tells one secret of a kind from another: of a private key the
    base64 of its body, however it is wrapped or quoted."""
    if kind != "pem":
        return span
    return F.regexp_replace(span, r"-----[A-Z ]+-----|(Proc-Type|DEK-Info): [A-Za-z0-9,-]*|\\[nrt]|[^A-Za-z0-9+/=]", "")


def _random_looking(kind: str, value: Column, after: Column) -> Column:
    """At least 6 different characters and no word of an example.  A private
    key's body has 24 characters; it may hold such a word by chance, from 64 on.
    An assigned value without a digit is no plain name (dotted, called, indexed
    or compared), and is long or mixed."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 6
    plain = ~holds_any(F.lower(value), EXAMPLE_WORDS)
    if kind == "pem":
        return varied & (F.char_length(value) >= 24) & (plain | (F.char_length(value) >= 64))
    if kind != "assign":
        return varied & plain
    name = value.rlike(r"^=|^[A-Za-z_]+([.][A-Za-z_]+)+$") | after.isin("(", "[")
    mixed = value.rlike(r"[a-z][A-Z].*[a-z][A-Z]|(?i)[bcdfghjklmnpqrstvwxz]{5}")
    return varied & plain & (value.rlike("[0-9]") | ~name & ((F.char_length(value) >= 12) | mixed))


def candidate_spans(text: Column) -> Column:
    """array of (start, kind number, end, hash of the value, looks random),
    by start and then kind; code points, end exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")

    def of_kind(k: int, low: Column) -> Column:
        kind, pattern, group, least, words = KINDS[k]
        value = lambda x: _value(kind, F.substring(text, x["e"] - x["n"] + 1, x["n"]))
        odd = lambda x: _random_looking(kind, value(x), F.substring(text, x["e"] + 1, F.lit(1)))
        found = F.transform(
            F.filter(places(text, F.lit(pattern), group), lambda x: x["n"] >= least),
            lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"),
                               F.xxhash64(value(x)).alias("h"), odd(x).alias("odd")))
        gate = holds_any(low, words) if words else text.rlike(pattern)
        return F.when(gate, found).otherwise(none)

    return let(F.lower(text), lambda low: F.array_sort(F.concat(*[of_kind(k, low) for k in range(len(KINDS))])))


def _name(s: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.concat_ws(":", F.element_at(names, s["k"] + 1), s["s"].cast("string"), s["e"].cast("string"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
               repo_col: str = "lang") -> DataFrame:
    """Narrow rows (key, id, owner, repo, spans), one a row of ``docs``.  A
    repository is an owner with one value of ``repo_col``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(common.row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"),
                       F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
                       candidate_spans(text).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Value hash with its numbers of distinct owners and repositories."""
    values = (found.where(F.size("spans") > 0)
              .select("owner", "repo", F.explode(F.array_distinct(F.transform("spans", lambda s: s["h"]))).alias("h")))
    per_owner = values.groupBy("h", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("h", "owner").agg(
        F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def live_spans(found: DataFrame) -> DataFrame:
    """key -> live: sorted spans (s, k, e) of owner-specific, random-looking values."""
    spans = (found.where(F.size("spans") > 0)
             .select("key", F.explode("spans").alias("x")).select("key", "x.*")
             .join(ownership(found), "h"))
    live = spans.where(F.col("odd") & (F.col("n_owners") < COPIED_OWNERS) & (F.col("n_repos") < COPIED_REPOS))
    return live.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("s", "k", "e"))).alias("live"))


def scan(docs: DataFrame, **columns: str) -> DataFrame:
    """Spans of every row with the corpus's verdict on them."""
    found = common.cut_lineage(candidates(docs, **columns))
    base = F.filter("spans", lambda s: s["k"] < BASE_KINDS)
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return (found.join(live_spans(found), "key", "left").select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE_KINDS)],
        F.sha2(F.array_join(F.transform(base, _name), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", _name), ",").alias("spans"),
        F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"),
        F.array_join(F.transform(F.coalesce("live", F.array().cast("array<struct<s:int,k:int,e:int>>")), _name), ",")
        .alias("live_spans"), "key"))


def may_hold(text: Column) -> Column:
    """False only for texts without any candidate span: what ``candidate_spans``
    asks before it looks for places."""
    low = F.lower(text)
    out = F.lit(False)
    for _, pattern, _, _, words in KINDS:
        out = out | (holds_any(low, words) if words else text.rlike(pattern))
    return F.coalesce(out, F.lit(False))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
           **columns: str) -> DataFrame:
    """``docs`` with each live credential replaced by ``mark``; columns as before.
    Rows without a candidate pass by; only the others meet the corpus's verdict."""
    maybe = may_hold(F.col(text_col))
    whole, docs = docs.where(~maybe), docs.where(maybe)
    found = common.cut_lineage(candidates(docs, id_col, text_col, **columns))
    key = common.row_key(F.col(id_col), F.col(text_col))
    text = F.col(text_col)

    def cut(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(
            F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)))).alias("out"))

    clean = F.aggregate("__live", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), cut,
                        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(
                            text, acc["at"] + 1, F.char_length(text))))
    live = live_spans(found).select(F.col("key").alias("__key"), F.col("live").alias("__live"))
    joined = docs.withColumn("__key", key).join(live, "__key", "left")
    return joined.withColumn(text_col, F.when(F.col("__live").isNotNull(), clean).otherwise(text)).drop(
        "__key", "__live").unionByName(whole)
