"""URL filter: given rules first, then a path-template tree with smoothed labelled purity (DataFrame operations only).

The tree of a host has the path's segments as levels.  A segment with digits becomes the wildcard of its shape; a
literal branch that few pages share becomes ``*``; sibling branches whose labelled rates can't be told apart from
their parent's (two-sided z test) are merged into one.  A template's purity is its share of good pages, smoothed
towards its host's and that towards the whole table's.  It is rejected if that is below one half, or if its bad share
is credibly, by the lower end of its interval, both above a limit and a multiple of the whole table's.

Pages are first summed by (host, template), map-side, so a host with a third of all pages is one row a template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm.session import table

#: (verdict, host with path): fixed values of the contract.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A literal branch of fewer pages becomes a wildcard.
MIN_BRANCH = 5
#: Sibling branches within this many standard errors of their parent are merged.
SIMILAR_Z = 1.96
#: Weight, in labelled pages, of the level above when purity is smoothed.
SMOOTHING = 5.0
#: A template whose smoothed share of good pages is below it is rejected.
MIN_PURITY = 0.5
#: So is one whose bad share, less so many standard errors, is above both a limit and a multiple of the table's.
BAD_Z, BAD_SHARE, BAD_RATIO = 1.96, 0.25, 2.0
#: Copies of a template row when pages look theirs up, for that many shapes with the most pages, so that their pages
#: don't meet in one task; any other shape has less than one page in HOT_SHAPES.
SALT, HOT_SHAPES = 32, 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' if null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' if null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(verdict, rule), or null.  ``rules`` is a short list in the plan."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """A segment with its variable parts as wildcards: digits, long hexadecimal runs, and words that hold digits."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("<n>"))
        .when(segment.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("<hex>"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("<n>."), F.regexp_extract(segment, r"\.([A-Za-z0-9]+)$", 1)))
        .when(segment.rlike(r"[0-9]"), F.lit("<x>"))
        .when(F.length(segment) > 40, F.lit("<long>"))
        .otherwise(segment)
    )


def path_shape(path: Column) -> Column:
    """The path, generalised, as one string like ``/en/<n>``."""
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)
    return F.concat_ws("/", F.lit(""), parts)


def templates(leaves: DataFrame) -> DataFrame:
    """Maps each (host, shape) of ``leaves(host, shape, n, labelled, good)`` to its ``template``, the template's
    ``purity``, and whether it is ``rejected``.

    Level by level: a rare literal becomes ``*``; then a branch that is statistically like its siblings taken
    together joins them under ``<any>`` if they have labels to be compared by.  It goes on until no branch has further
    segments; a shape alone in its branch has no siblings to come and is named to its end at once.
    """
    t = leaves.withColumns({"parts": F.filter(F.split("shape", "/"), lambda s: s != ""), "template": F.lit("")})
    named = lambda seg, n: F.when((n < MIN_BRANCH) & ~seg.startswith("<"), F.lit("*")).otherwise(seg)
    ended: list[DataFrame] = []
    k = 0
    while not ended or not t.isEmpty():
        seg = F.coalesce(F.try_element_at("parts", F.lit(k + 1)), F.lit(None).cast("string"))
        t = t.withColumn("seg", seg)
        branch = t.groupBy("host", "template", "seg").agg(F.sum("n").alias("bn"), F.sum("labelled").alias("bl"), F.sum("good").alias("bg"), F.count("*").alias("shapes"))
        branch = branch.withColumn("name", F.when(F.col("seg").isNull(), F.lit(None)).otherwise(named(F.col("seg"), F.col("bn"))))
        parent = branch.groupBy(F.col("host").alias("ph"), F.col("template").alias("pt")).agg(F.sum("bl").alias("pl"), F.sum("bg").alias("pg"), F.count("name").alias("kinds"), F.sum("shapes").alias("shapes_in"))
        b = branch.join(parent, (F.col("host") == F.col("ph")) & (F.col("template") == F.col("pt")))
        rate = F.try_divide(F.col("pg"), F.col("pl"))
        z = F.abs(F.try_divide(F.col("bg"), F.col("bl")) - rate) / F.sqrt((rate * (1 - rate) + 1e-9) / F.col("bl"))
        alike = (F.col("kinds") > 1) & (F.col("bl") > 0) & (z <= SIMILAR_Z) & F.col("name").isNotNull()
        b = b.select(F.col("host").alias("bh"), F.col("template").alias("bt"), F.col("seg").alias("bs"), F.when(alike, F.lit("<any>")).otherwise(F.col("name")).alias("name"), (F.col("shapes_in") == 1).alias("alone"))
        rest = F.transform(F.slice("parts", k + 2, F.greatest(F.size("parts"), F.lit(1))), lambda s: named(s, F.col("n")))
        t = t.join(b, (F.col("host") == F.col("bh")) & (F.col("template") == F.col("bt")) & F.col("seg").eqNullSafe(F.col("bs"))).select(
            "host", "shape", "n", "labelled", "good", "parts", F.concat_ws("/", "template", F.col("name"), F.when(F.col("alone"), rest)).alias("template"), (F.col("alone") | F.col("seg").isNull()).alias("ended")
        )
        t = table(t, "templates")
        ended.append(t.where("ended").drop("ended"))
        t = t.where("not ended").drop("ended")
        k += 1
    t = ended[0]
    for more in ended[1:]:
        t = t.unionByName(more)
    total = t.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("all_share"))
    host = t.groupBy(F.col("host").alias("hh")).agg(F.sum("good").alias("hg"), F.sum("labelled").alias("hl")).crossJoin(F.broadcast(total))  # one row
    host = host.select("hh", "all_share", ((F.col("hg") + SMOOTHING * F.col("all_share")) / (F.col("hl") + SMOOTHING)).alias("host_share"))
    leaf = t.groupBy(F.col("host").alias("th"), F.col("template").alias("tt")).agg(F.sum("n").alias("template_pages"), F.sum("good").alias("tg"), F.sum("labelled").alias("tl"))
    leaf = leaf.join(host, F.col("th") == F.col("hh")).select("th", "tt", "template_pages", "tl", "all_share", ((F.col("tg") + SMOOTHING * F.col("host_share")) / (F.col("tl") + SMOOTHING)).alias("purity"))
    error = F.sqrt(F.col("purity") * (1 - F.col("purity")) / (F.col("tl") + SMOOTHING))
    bad = F.greatest(F.lit(BAD_SHARE), BAD_RATIO * (1 - F.col("all_share")))
    leaf = leaf.withColumn("rejected", (F.col("purity") < MIN_PURITY) | (1 - F.col("purity") - BAD_Z * error > bad))
    return t.join(leaf, (F.col("host") == F.col("th")) & (F.col("template") == F.col("tt"))).select("host", "shape", "n", "template", "template_pages", "purity", "rejected")


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity): one row per row of ``pages``.

    ``labels(number long, good int)`` marks pages by the first number in their path; null or absent labels count as
    none.  A url that is null or has no ``://`` has an empty host and path, fits no rule, and is judged by the
    template tree like any other.  Repeated rows are judged alike.  With no labels at all purity is one half and
    nothing is rejected.  Other columns of ``pages`` are not read.
    """
    u = F.col(url)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    base = base.withColumn("shape", path_shape(F.col("path")))
    summed = base.withColumn("number", F.try_to_number(F.nullif(F.regexp_extract("path", r"/([0-9]{1,18})(?:[./]|$)", 1), F.lit("")), F.lit("9" * 18)).cast("long")).groupBy("host", "shape", "number").agg(F.count("*").alias("n"))
    if labels is None:
        leaves = summed.groupBy("host", "shape").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("good"))
    else:
        known = labels.where(F.col("number").isNotNull() & F.col("good").isNotNull()).groupBy(F.col("number").alias("label_number")).agg(F.max("good").alias("good"))
        # pages without a number have no label: they skip the join, where they would all meet
        numbered = summed.where("number is not null").join(known, F.col("number") == F.col("label_number"), "left").select("host", "shape", "n", F.when(F.col("good").isNotNull(), F.col("n")).alias("labelled"), (F.col("n") * F.col("good")).alias("good"))
        rest = summed.where("number is null").select("host", "shape", "n", F.lit(None).cast("long").alias("labelled"), F.lit(None).cast("long").alias("good"))
        leaves = numbered.unionByName(rest).groupBy("host", "shape").agg(F.sum("n").alias("n"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    leaves = table(leaves, "leaves")
    hot = leaves.orderBy(F.desc("n"), "host", "shape").limit(HOT_SHAPES).select(F.col("host").alias("hot_host"), F.col("shape").alias("hot_shape"))
    marked = lambda df: df.join(F.broadcast(hot), (F.col("host") == F.col("hot_host")) & (F.col("shape") == F.col("hot_shape")), "left")  # noqa: E731  HOT_SHAPES rows
    copies = F.when(F.col("hot_host").isNotNull(), F.lit(SALT)).otherwise(1)
    tree = marked(templates(leaves)).select(F.col("host").alias("kh"), F.col("shape").alias("ks"), "template", "purity", "rejected", F.explode(F.sequence(F.lit(0), copies - 1)).alias("kx"))
    salted = marked(base).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), copies).cast("int"))
    out = salted.join(tree, (F.col("host") == F.col("kh")) & (F.col("shape") == F.col("ks")) & (F.col("salt") == F.col("kx")), "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumn("ruled", rule)
    return out.select(
        F.col("page_id").alias(id_col),
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
        "purity",
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; the number in a path names the document whose quality label is the page's."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("number"), F.col("quality").alias("good"))
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels)


def sql(levels: int = 8) -> str:
    """The query over ``pages`` and ``labels`` as SQL for DuckDB, for paths of fewer segments than ``levels``."""
    segment = f"""case when regexp_matches(s, '^[0-9]+$') then '<n>' when regexp_matches(s, '^[0-9a-fA-F-]{{16,}}$') then '<hex>'
      when regexp_matches(s, '^[0-9]+\\.[A-Za-z0-9]{{1,5}}$') then concat('<n>.', regexp_extract(s, '\\.([A-Za-z0-9]+)$', 1))
      when regexp_matches(s, '[0-9]') then '<x>' when length(s) > 40 then '<long>' else s end"""
    named = lambda s, n: f"case when {n} < {MIN_BRANCH} and not starts_with({s}, '<') then '*' else {s} end"
    fits = [(len(r), v, r, *r.split("/", 1)) for v, r in RULES]
    cases = lambda pick: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{rest}') then '{pick(v, r)}'" for _, v, r, h, rest in sorted(fits, reverse=True)) + " end"
    out = f"""with base as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{SMALL}'), '') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
shaped as (select *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {segment}) parts,
  {cases(lambda v, r: r)} ruled, {cases(lambda v, r: v)} ruling, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1), '') as bigint) number from base),
known as (select doc_id, max(quality) good from labels where doc_id is not null and quality is not null group by doc_id),
t0 as (select host, parts, count(*) n, count(good) labelled, coalesce(sum(good), 0) good, '' template from shaped left join known on doc_id = number group by host, parts)"""
    for k in range(levels):
        out += f""",
b{k} as (select host, template, parts[{k + 1}] seg, sum(n) bn, sum(labelled) bl, sum(good) bg, count(*) shapes from t{k} group by all),
n{k} as (select *, case when seg is not null then {named("seg", "bn")} end name from b{k}),
p{k} as (select host, template, sum(bl) pl, sum(bg) pg, count(name) kinds, sum(shapes) shapes_in, cast(sum(bg) as double) / cast(nullif(sum(bl), 0) as double) rate from n{k} group by all),
c{k} as (select n.host, n.template, n.seg, case when kinds > 1 and bl > 0 and name is not null
    and abs(cast(bg as double) / cast(bl as double) - rate) / sqrt((rate * (1 - rate) + 1e-9) / cast(bl as double)) <= {SIMILAR_Z} then '<any>' else name end name, shapes_in = 1 alone
  from n{k} n join p{k} p on p.host = n.host and p.template = n.template),
u{k} as (select t.host, t.parts, t.n, t.labelled, t.good, concat(t.template, '/' || c.name, case when alone then array_to_string(list_transform(parts[{k + 2}:], lambda s: concat('/', {named("s", "t.n")})), '') else '' end) template, alone or c.seg is null ended
  from t{k} t join c{k} c on c.host = t.host and c.template = t.template and c.seg is not distinct from t.parts[{k + 1}]),
t{k + 1} as (select * exclude (ended) from u{k} where not ended)"""
    ended = " union all ".join(f"select * exclude (ended) from u{k} where ended" for k in range(levels))
    return out + f""",
t as ({ended}),
total as (select cast(coalesce(sum(good), 0) + 1 as double) / cast(coalesce(sum(labelled), 0) + 2 as double) all_share from t),
hosts as (select host, (cast(sum(good) as double) + {SMOOTHING} * any_value(all_share)) / (cast(sum(labelled) as double) + {SMOOTHING}) host_share from t, total group by host),
leaf as (select t.host, t.template, cast(sum(labelled) as double) tl, (cast(sum(good) as double) + {SMOOTHING} * any_value(host_share)) / (cast(sum(labelled) as double) + {SMOOTHING}) purity
  from t join hosts h on h.host = t.host group by t.host, t.template),
judged as (select *, purity < {MIN_PURITY} or 1 - purity - {BAD_Z} * sqrt(purity * (1 - purity) / (tl + {SMOOTHING})) > greatest({BAD_SHARE}e0, {BAD_RATIO} * (1 - all_share)) rejected from leaf, total)
select page_id, s.host, path, ruled "rule", coalesce(ruling, case when rejected then 'block' else 'allow' end) verdict, t.template, purity
from shaped s left join t on t.host = s.host and t.parts = s.parts left join judged j on j.host = t.host and j.template = t.template"""
