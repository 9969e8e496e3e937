"""URL filters: rules by host and path, carried along redirect and canonical-link edges.

DataFrame operations only. ``judge`` takes urls, rules and edges; ``page_edges`` finds the edges that pages declare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table
from .components import components

#: The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What holds no tags: comments (to the end where unclosed), scripts and styles.
_HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)"
#: Where a tag begins; what follows is its name. Then each attribute, from the end of the one before: what stands up to ``=``, the
#: last word of which is its name, and its value, which is quoted or goes up to white space. Quotes elsewhere are characters.
_TAG = r"(?i)<(?=(?:link|meta|base)[\s/>])"
_ATTRIBUTE = r"""\G([^>=]*+)=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?+)"""
_REFRESH = r"(?is)^\s*[0-9.]+\s*[;,\s]\s*(?:url\s*=\s*)?(.+)$"
#: Entities that are read in addresses, the ampersand last.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _ADDRESS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def without_dots(path: Column) -> Column:
    """``path`` with ``.`` and ``..`` segments taken out."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    whole = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), whole).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a url: absolute, ``//host``, ``/path``, ``?query``, or relative to the folder of the page ``url``."""
    path = path_of(url)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    base = F.concat(F.lit("http://"), host_of(url))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.rlike(r"^[?#]"), F.concat(base, path, target))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def node_of(url: Column) -> Column:
    """What aliases are classes of: host without its scheme's own port, path without dot segments (none: ``/``) and query; neither
    scheme nor fragment. Urls that differ in their query are different nodes. Null without a host."""
    path = without_dots(path_of(url))
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    port = F.when(url.rlike("(?i)^http:"), ":(80)?$").when(url.rlike("(?i)^https:"), ":(443)?$").otherwise(":$")
    host = F.regexp_replace(host_of(url), port, "")
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def _decoded(value: Column) -> Column:
    """``value`` with numeric and the common named entities read, once."""
    numbers = F.regexp_extract_all(value, F.lit(r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"), 0)

    def char(e: Column) -> Column:
        digits = F.regexp_extract(e, "(?i)&#x?([0-9a-f]+);", 1)
        code = F.when(e.rlike("(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        code = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), code).otherwise(0xFFFD)
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    # An ampersand that a number spells begins no entity, so it waits under a sign that is no part of an address.
    out = F.aggregate(F.array_distinct(numbers), value, lambda v, e: F.replace(v, e, F.replace(char(e), F.lit("&"), F.lit("\0"))))
    for entity, sign in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.replace(out, F.lit("\0"), F.lit("&"))


def _attributes(tag: Column) -> Column:
    """The attributes of a tag, (name in lower case, value), in order."""
    parts = [F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), k) for k in range(1, 5)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "nabc")))
    name = lambda x: ascii_lower(F.regexp_extract(x["n"], r"""([^\s"'<>/]+)\s*+$""", 1))
    return F.transform(zipped, lambda x: F.struct(name(x).alias("name"), F.concat(x["a"], x["b"], x["c"]).alias("value")))


def _closed(tag: Column) -> Column:
    """Whether a tag ends, after its last attribute."""
    read = F.aggregate(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 0), F.lit(0), lambda n, x: n + F.length(x))
    return F.regexp_like(F.substr(tag, read + 1), F.lit("^[^>=]*+>"))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst), urls, for each canonical link and each refresh redirect in ``html``, however many a page has.

    Tags in comments, scripts and styles don't count. ``rel`` is a list of words, of which one is ``canonical``; of an attribute
    given twice the first counts; entities in values are read. Targets are resolved against the first ``<base href>``, or the
    page's url; those of other schemes than http and https are no edges. Null, empty, very long and broken pages give the
    edges that they show.
    """
    shown = F.regexp_replace("html", _HIDDEN, " ")
    parts = F.split(shown, _TAG, -1)
    tags = pages.where(F.col("html").isNotNull() & (host_of(F.col("url")) != "")).select("url", F.filter(F.slice(parts, 2, F.size(parts)), _closed).alias("tags"))
    kind = lambda t: ascii_lower(F.regexp_extract(t, "^([A-Za-z]+)", 1))
    read = F.transform("tags", lambda t: F.struct(kind(t).alias("kind"), _attributes(t).alias("has")))
    tags = tags.where("size(tags) > 0").select("url", read.alias("tags"))

    def value(tag: Column, name: str) -> Column:
        return F.get(F.filter(tag.has, lambda x: x["name"] == name), F.lit(0)).value

    def address(v: Column) -> Column:
        return F.trim(F.regexp_replace(_decoded(v), r"[\t\r\n]", ""))

    tags = tags.select("url", F.transform("tags", lambda t: F.struct(t.kind.alias("kind"), value(t, "href").alias("href"), value(t, "rel").alias("rel"), value(t, "http-equiv").alias("equiv"), value(t, "content").alias("content"))).alias("tags"))
    base = F.get(F.filter("tags", lambda t: (t.kind == "base") & t.href.isNotNull()), F.lit(0)).href
    based = tags.select("url", F.coalesce(address(base), F.lit("")).alias("base"), F.explode("tags").alias("t"))
    rel = F.split(F.trim(ascii_lower(F.col("t.rel"))), r"\s+")
    told = F.regexp_extract(_decoded(F.col("t.content")), _REFRESH, 1)
    quoted = F.regexp_extract(told, r"""(?s)^(["'])(.*?)(?:\1|$)""", 2)
    refresh = F.trim(F.regexp_replace(F.when(told.rlike("""^["']"""), quoted).otherwise(told), r"[\t\r\n]", ""))
    target = F.when((F.col("t.kind") == "link") & F.array_contains(rel, "canonical"), address(F.col("t.href")))
    target = target.when((F.col("t.kind") == "meta") & (F.trim(ascii_lower(F.col("t.equiv"))) == "refresh"), refresh)
    links = based.select("url", "base", target.alias("target")).where("target <> ''")
    web = ~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.col("target").rlike("(?i)^https?://")
    against = F.when((F.col("base") == "") | ~(~F.col("base").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.col("base").rlike("(?i)^https?://")), F.col("url")).otherwise(resolved(F.col("base"), F.col("url")))
    links = links.where(web).select("url", "target", against.alias("against"))
    return links.select(F.col("url").alias("src"), resolved(F.col("target"), F.col("against")).alias("dst"))


#: Rules that are sent to all tasks, at most; more are met in tasks by suffix, each suffix in so many parts.
BROADCAST_RULES, PARTS = 100_000, 16
#: Classes of more nodes than this, or one in so many of all, are decided by a broadcast: there are at most LARGE_SHARE.
LARGE_CLASS, LARGE_SHARE = 100_000, 1000


def match_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for the distinct ``addresses`` (host, path) that a rule fits.

    A rule fits its host and every subdomain if the path starts with the rule's. The longest host and path win,
    ties going to allow. Each address asks for its host's suffixes (one per label) and, of its path, only prefixes
    of a length that some rule of that suffix has, so that every lookup is an equality join however many rules
    there are. Rules with a null part are ignored; repeated rules count once.
    """
    rules = rules.select("rule_host", "rule_path", "action").dropna().distinct()
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    few = rules.count() <= BROADCAST_RULES
    part = F.pmod(F.xxhash64("host", "path"), F.lit(PARTS)).cast("int")

    def met(asked: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
        """An equality join in which no suffix, however common, is one task's: all rules go along, or a copy to each part."""
        if few:
            return asked.join(F.broadcast(by), keys)
        copies = by.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        return asked.withColumn("part", part).join(copies, [*keys, "part"]).drop("part")

    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    asked = (
        addresses.where("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("rule_host"))
        .transform(met, lengths, ["rule_host"])
        .select("host", "path", "rule_host", F.explode("lengths").alias("n"))
        .where("length(path) >= n")
        .select("host", "path", "rule_host", F.expr("substr(path, 1, n)").alias("rule_path"))
    )
    rank = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("n"), (F.col("action") == "allow").alias("allow")
    )
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), rank)
    return (
        met(asked, rules, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(best.alias("best"))
        .select("host", "path", "best.rule", "best.action")
    )


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and how the verdict came about (``reason``).

    A page's own rule decides first ("rule"). Otherwise it takes the verdict of its class of aliases, the connected component
    of its ``node_of`` over ``edges`` (src, dst: urls): allow if a rule allows any member, else block if a rule blocks any
    ("alias"); addresses with neither are allowed ("default"). Members need not be in ``pages``. Null, empty and malformed
    urls have an empty host and path and are allowed; edges with such an end are ignored. Repeated rows stay repeated; an
    empty table gives an empty result; columns other than those named are not read.
    """
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    addresses = seen.select("host", "path")
    classes = None
    if edges is not None:
        edges = stored(edges.select("src", "dst").where((host_of(F.col("src")) != "") & (host_of(F.col("dst")) != "")).distinct(), "links")
        ends = edges.select(F.col("src").alias("url")).union(edges.select("dst")).distinct()
        ends = ends.select(node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), without_dots(path_of(F.col("url"))).alias("path"))
        addresses = addresses.union(ends.select("host", "path"))
        classes = components(edges.select(node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v")))
    ruled = match_rules(addresses.distinct(), rules)
    out = seen.join(ruled, ["host", "path"], "left")
    inherited = F.lit(None).cast("string")
    if classes is not None:
        acted = ends.join(ruled, ["host", "path"]).select("node", "action").distinct()
        decided = classes.join(acted, "node").groupBy("component").agg(F.min("action").alias("inherited"))  # allow before block
        sizes = stored(classes.groupBy("component").count(), "class-sizes")
        most = F.greatest(F.lit(LARGE_CLASS), F.floor(F.sum("count") / LARGE_SHARE)).alias("most")
        large = sizes.where(F.col("count") > (sizes.agg(most).first().most or LARGE_CLASS)).select("component")
        giant = decided.join(F.broadcast(large), "component")  # at most LARGE_SHARE rows
        small = classes.join(F.broadcast(large), "component", "left_anti").join(decided, "component")
        alias = small.select("node", "inherited").unionByName(classes.join(F.broadcast(giant), "component").select("node", "inherited"))
        out = out.withColumn("node", node_of(F.col("url"))).join(alias, "node", "left")
        inherited = F.col("inherited")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", inherited, F.lit("allow")).alias("verdict"),
        F.when(F.col("action").isNotNull(), "rule").when(inherited.isNotNull(), "alias").otherwise("default").alias("reason"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, action string")
    return judge(pages, rules, page_edges(pages))


ORACLE = """
WITH p AS (SELECT page_id, url, strpos(url, '://') AS i FROM pages),
q AS (SELECT page_id, CASE WHEN i > 0 THEN substr(url, i + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host FROM q),
a AS (SELECT page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
r(rule_host, rule_path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(action, length(rule_host || rule_path)) AS action
  FROM (SELECT DISTINCT host, path FROM a) JOIN r
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict,
  CASE WHEN action IS NULL THEN 'default' ELSE 'rule' END AS reason
FROM a LEFT JOIN m USING (host, path)
"""
