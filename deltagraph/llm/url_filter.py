"""URL filtering against a list of host/path rules.

A blocked Bloom filter over the canonical listed URLs passes the possible hits; an exact hash join
with the list then removes false positives.  Built-in DataFrame functions only.

The filter is one value of bounded size that every row is tested against where it lies; rows that it rules out are
passed on as they are, and only possible hits take part in the join.

A rule is (host, path, action): it fits its host and all subdomains, if the URL's path starts with the
rule's path; of several fitting rules the one with the longest host + path wins (ties: the longer host).

Every URL is turned into its candidate keys "host-suffix + path-prefix", where only the suffix depths and
prefix lengths that occur in the list are tried, so the list, not the URL, bounds their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltagraph.llm.common import Workspace, ascii_lower, small, table

#: Rules of the query: (host, path, action).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Verdict of the method for a URL that neither a rule nor its own list has.
UNLISTED = "allow"
#: The method's own list, hosts of well-known advertising and tracking networks.
METHOD_HOSTS = [
    "adnxs.com", "adroll.com", "advertising.com", "amazon-adsystem.com", "bluekai.com", "casalemedia.com", "criteo.com", "doubleclick.net",
    "googleadservices.com", "googlesyndication.com", "mathtag.com", "moatads.com", "openx.net", "outbrain.com", "pubmatic.com", "quantserve.com",
    "rubiconproject.com", "scorecardresearch.com", "taboola.com", "zedo.com",
]
METHOD_BLOCKS = [(h, "", "block") for h in METHOD_HOSTS]

#: A Bloom block is 8 words of 32 bits; a key sets one bit in each word (about 16 bits a key below).
WORDS, BITS = 8, 32
#: Blocks of the filter at most (8 MB); a longer list fills it up, which lets more rows through and changes no result.
MOST_BLOCKS = 1 << 17
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A list of (host, path, action) as a table."""
    rows = [F.struct(*[F.lit(x).alias(c) for c, x in zip(("host", "path", "action"), r)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    low = F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF))  # so that a product with a salt fits a long
    bit = lambda salt: F.shiftright((low * F.lit(salt)).bitwiseAND(F.lit(0xFFFFFFFF)), 27)
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(s).cast("int")) for s in SALTS]


@dataclass
class BlockedBloom:
    """``words``: a table of one row and column, the blocks as an array of arrays of WORDS words."""

    words: DataFrame
    blocks: int

    @classmethod
    def build(cls, keys: DataFrame, key: str, n: int) -> BlockedBloom:
        blocks = min(MOST_BLOCKS, max(1, (n * 16 + WORDS * BITS - 1) // (WORDS * BITS)))
        rows = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(key)))])
        filled = rows.groupBy("block").agg(F.array(*[F.bit_or(f"m{i}") for i in range(WORDS)]).alias("w"))
        none = keys.sparkSession.range(blocks).select(F.col("id").alias("block"), F.array(*[F.lit(0).cast("bigint")] * WORDS).alias("w"))
        whole = none.unionByName(filled).groupBy("block").agg(*[F.bit_or(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(WORDS)])
        block = F.struct("block", F.array(*[F.col(f"w{i}") for i in range(WORDS)]).alias("w"))
        return cls(whole.agg(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["w"]).alias("words")), blocks)

    def value(self) -> Column:
        return self.words.scalar()

    def possible(self, words: Column, key: Column) -> Column:
        """Whether ``key`` may be listed; ``words``: a column with the filter's value."""
        own = F.get(words, _block(key, self.blocks).cast("int"))
        hit = F.lit(True)
        for i, m in enumerate(_masks(key)):
            hit &= F.get(own, F.lit(i)).bitwiseAND(m) != 0
        return F.coalesce(hit, F.lit(False))


RESULT = ["url_host", "url_path", "url_rule", "url_verdict"]


def filter_urls(df: DataFrame, url: str, rules: DataFrame, unlisted: str = UNLISTED, extra: DataFrame | None = None) -> DataFrame:
    """All rows and columns of ``df`` plus ``url_host``, ``url_path``, ``url_rule``, ``url_verdict``.

    ``rules`` and ``extra`` have columns host, path, action.  ``extra`` are entries of the method's own: they decide
    only where no rule fits, and show no rule.  A null URL, or one without ``://``, has empty host and path, fits no
    rule and gets ``unlisted``.  Repeated rows are judged alike and all returned; an empty list or an empty
    table is fine.  Columns may have any name; those with the name of a result column give way to it."""
    ws = Workspace(df.sparkSession, "urls")
    listed = rules.select("host", "path", "action", F.lit(1).alias("given"))
    if extra is not None:
        listed = listed.unionByName(extra.select("host", "path", "action", F.lit(0).alias("given")))
    listed = ws.save(
        listed.where(F.col("host").isNotNull())
        .withColumn("host", ascii_lower(F.col("host")))
        .withColumn("path", F.coalesce("path", F.lit("")))
        .groupBy("host", "path").agg(F.max_by(F.struct("action", "given"), F.struct("given", "action")).alias("a"))
        .select(F.concat("host", "path").alias("key"), F.col("host").alias("h"), F.col("path").alias("p"), "a.action", "a.given"), "listed")
    # numbers of labels and lengths of paths that occur: a few, whatever the list's length
    shape = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("p")).alias("lengths"), F.collect_set(F.size(F.split("h", r"\."))).alias("depths")).first()
    n, lengths, depths = shape["n"], sorted(shape["lengths"]), sorted(shape["depths"])

    others = [c for c in df.columns if c not in RESULT]
    host, path = split_url(F.col(url))
    judged = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)], host.alias("host"), path.alias("path"))
    told = lambda rows, rule, verdict: rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(others)], F.col("host").alias("url_host"), F.col("path").alias("url_path"), rule.alias("url_rule"), verdict.alias("url_verdict"))
    none = (F.lit(None).cast("string"), F.lit(unlisted))
    if n == 0:
        return told(judged, *none)

    labels = F.size(F.split("host", r"\."))
    suffix = F.array(*[F.when((labels >= d) & (F.col("host") != ""), F.substring_index("host", ".", -d)) for d in depths])
    prefix = F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths])
    keys = F.flatten(F.transform(F.filter(suffix, lambda h: h.isNotNull()), lambda h: F.transform(F.filter(prefix, lambda p: p.isNotNull()), lambda p: F.struct(h.alias("h"), p.alias("p"), F.concat(h, p).alias("key")))))
    bloom = BlockedBloom.build(listed, "key", n)
    marked = judged.withColumn("keys", keys).withColumn("words", bloom.value())
    marked = marked.withColumn("keys", F.filter("keys", lambda k: bloom.possible(F.col("words"), k["key"]))).drop("words")
    hits, rest = marked.where(F.size("keys") > 0), marked.where(F.size("keys") == 0)
    urls = hits.groupBy("host", "path").agg(F.first("keys").alias("keys"))  # the keys follow from host and path
    each = urls.select("host", "path", F.inline("keys"))
    exact = each.join(small(listed, n), ["key", "h", "p"])
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct("key", "action", "given"), F.struct("given", F.length("key"), F.length("h"))).alias("won"))
    # stored, so that its size is known, and a larger one is joined with an exchange on either side, where a hot URL can be split
    best = ws.save(best, "best")
    found = hits.join(small(best, best.count()), ["host", "path"], "left")
    return told(found, F.when(F.col("won.given") == 1, F.col("won.key")), F.coalesce("won.action", F.lit(unlisted))).unionByName(told(rest, *none))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules, extra = rule_table(spark, RULES), rule_table(spark, METHOD_BLOCKS)
    out = filter_urls(pages, "url", rules, extra=extra)
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def _rule_case(of: str) -> str:
    rules = sorted(RULES if of == "rule" else [*RULES], key=lambda r: -len(r[0] + r[1]))
    when = lambda h, p, x: f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{x}'"
    given = [when(h, p, h + p if of == "rule" else a) for h, p, a in rules]
    own = [] if of == "rule" else [when(h, p, a) for h, p, a in METHOD_BLOCKS]
    return f"CASE {' '.join(given + own)} ELSE {'NULL' if of == 'rule' else repr(UNLISTED)} END"


ORACLE = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, {_rule_case('rule')} AS rule, {_rule_case('verdict')} AS verdict FROM s
"""
