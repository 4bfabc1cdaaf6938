"""Problem 1: text that looks the same but differs in its characters.

The consistent form of a text is its confusables skeleton (Unicode UTS #39): decompose, replace
every character by the prototype of its look-alike class, drop what shows nothing, decompose again.
The look-alike table isn't kept here; it is built once per driver from the ICU library that Spark
ships, over all code points, so its size is bounded by Unicode's.

Three choices keep apart what a reader can tell apart, where the table alone doesn't:

* ASCII letters and digits and ``|`` are their own prototypes (the table has I, l, 1, | as one,
  likewise O and 0, m and rn); what the table sends to them goes to the one of the same kind:
  capitals to I, digits to 1 and 0, others to l.
* Full-width forms go to the ordinary ones (the table keeps some).
* Dashes of en width or more are not hyphens.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep
from .arrow import map_batches

_KEPT = "|ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_DASHES = "‒–−"
_LINE = "\r\x0b\x0c\x85\u2028\u2029"


def _kind(c: str, prototype: str) -> str:
    """The table's prototype, with I, l, 1 and O, 0 and m kept apart by what kind of character ``c`` is."""
    digit = unicodedata.digit(c, None)
    if prototype in ("l", "O") and digit in (0, 1):
        return str(digit)
    if prototype == "l" and unicodedata.category(c) in ("Lu", "Lt"):
        return "I"
    if prototype == "rn":
        return "m"
    return prototype


@cache
def _table(_app: str) -> dict[int, str]:
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    checker = getattr(jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
    points = [chr(i) for i in range(0xA0, 0x110000) if not 0xD800 <= i < 0xE000]
    unseen = regex.compile(r"\p{Default_Ignorable_Code_Point}")
    out: dict[int, str] = {}
    for k in range(0, len(points), 50_000):
        block = points[k : k + 50_000]
        for c, got in zip(block, checker.getSkeleton("\n".join(block)).split("\n"), strict=True):
            if unseen.match(c):
                to = ""
            elif unicodedata.category(c) == "Zs":
                to = " "
            elif c in _LINE:
                to = "\n"
            elif c in _DASHES:
                continue
            elif 0xFF01 <= ord(c) <= 0xFF5E:
                to = chr(ord(c) - 0xFEE0)
            else:
                to = _kind(c, got)
            if to != unicodedata.normalize("NFD", c):
                out[ord(c)] = to
    for i in (*range(0x20), *range(0x7F, 0xA0)):
        out[i] = "\n" if chr(i) in "\n" + _LINE else " " if chr(i) == "\t" else ""
    for c in '"%`':  # ASCII signs with a prototype of their own
        out[ord(c)] = checker.getSkeleton(c)
    return {k: v for k, v in out.items() if chr(k) not in _KEPT and v != chr(k)}


def look_alikes(spark: SparkSession) -> dict[int, str]:
    """Code point to prototype, for ``str.translate``; from ICU's confusables."""
    return _table(spark.sparkContext.applicationId)


def skeleton(text: str, table: dict[int, str]) -> str:
    """The consistent form of ``text``; idempotent."""
    if text.isascii() and text.isalnum():
        return text
    text = unicodedata.normalize("NFD", text).translate(table)
    return text if text.isascii() else unicodedata.normalize("NFD", text)


def with_skeleton(df: DataFrame, keys: list[str], text: str = "content", *, full: bool = False) -> DataFrame:
    """``keys`` with ``look`` (and ``written``), 16-byte digests of the text's skeleton (of the text); ``full``: with the skeleton.

    Null texts are left out. Empty texts have the empty skeleton.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(look_alikes(spark))  # bounded by Unicode's size
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", look binary, written binary" + ", skeleton string" * full

    def work(cols: dict, table: dict) -> dict:
        texts = cols["__text"].to_pylist()
        forms = [skeleton(t, table) for t in texts]
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        look = [digest(s) for s in forms]
        written = [h if s == t else digest(t) for s, t, h in zip(forms, texts, look, strict=True)]
        return {k: cols[k] for k in keys} | {"look": look, "written": written} | ({"skeleton": forms} if full else {})

    return map_batches(df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text")), work, schema, setup=lambda: shared.value)


def look_classes(df: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """One row per distinct key and text: ``keys``, ``look`` (the class), ``written`` and the text's ``skeleton``."""
    return with_skeleton(df, keys, text, full=True).dropDuplicates([*keys, "look", "written"])


def look_alike_pairs(df: DataFrame, group: str, key: str, text: str = "content") -> DataFrame:
    """``group``, ``id_a``, ``id_b``: keys whose texts are written differently and have one skeleton.

    Keys with the same text are never paired with each other: within a class only the distinct
    writings are paired, then each side is expanded to its keys, so a text copied into a third of
    all rows costs its own rows, not their square. Repeated rows count once; null keys, groups and
    texts are left out; a key with two texts of one class isn't paired with itself.
    """
    rows = keep(with_skeleton(df.where(F.col(group).isNotNull() & F.col(key).isNotNull()), [group, key], text))
    # one row per class tells whether it has two writings: min and max are pre-aggregated before the shuffle
    mixed = rows.groupBy(group, "look").agg(F.min("written").alias("lo"), F.max("written").alias("hi")).where("lo <> hi").select(group, "look")
    rows = rows.join(mixed, [group, "look"], "left_semi").distinct()
    writings = rows.select(group, "look", "written").distinct()
    pairs = writings.join(writings.withColumnRenamed("written", "other"), [group, "look"]).where("written < other")
    left = rows.withColumnRenamed(key, "a").drop("look")
    right = rows.select(group, F.col("written").alias("other"), F.col(key).alias("b"))
    both = pairs.join(left, [group, "written"]).join(right, [group, "other"]).where("a <> b")
    return both.select(group, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
