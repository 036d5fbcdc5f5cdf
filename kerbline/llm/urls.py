"""URL filters: a list of host and path rules, and association rules that FP-growth mines from what the list decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import cut_lineage

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.6
LABEL = "verdict="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str) -> dict[str, Column]:
    """host (A-Z lower-cased) and path; both empty without ``://``.  Then scheme, query and fragment."""
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    return {
        "host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        "scheme": F.when(at > 0, F.translate(F.substring(whole, F.lit(1), at - 1), UPPER, LOWER)).otherwise(""),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(rest, "^[^#]*#([\\s\\S]*)", 1),
    }


def listed_rule(rules: Sequence[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """The longest rule (struct of rule and verdict) that fits a host or one of its parents and starts the path; null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r_host, r_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col(host) == r_host) | F.col(host).endswith(f".{r_host}")) & F.col(path).startswith(r_path)
        out = F.when(fits, F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens() -> Column:
    """What a URL says, without numbers: top-level domain, domain, words of the subdomains, path segments, query keys, fragment, scheme."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    sub = F.split(F.regexp_replace(F.array_join(F.slice(labels, 1, F.greatest(n - 2, F.lit(0))), "."), "-", "."), r"\.")
    keys = F.transform(F.split("query", "&"), lambda q: F.regexp_extract(q, "^[^=]*", 0))
    parts = F.transform(F.split("path", "/"), lambda s: F.regexp_replace(s, "[0-9]+", "0"))

    def tagged(tag: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(tag + ":"), v))

    return F.array_sort(
        F.array_distinct(
            F.concat(
                tagged("tld", F.slice(labels, -1, 1)), tagged("domain", F.array(F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."))),
                tagged("sub", sub), tagged("path", parts), tagged("key", keys), tagged("fragment", F.array("fragment")), tagged("scheme", F.array("scheme")),
            )
        )
    )


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from rows (tokens, verdict).

    FP-growth counts the frequent combinations of tokens and verdict over all rows.  A rule stays if it is confident
    and no part of its tokens says the same at least as surely, whatever its length: only support and confidence
    prune.  Parts are looked up under their first token.  The support is a share of the rows, so the number of rules
    depends on how tokens go together, not on the number of rows.
    """
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    said = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    sure = cut_lineage(
        said.filter(F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda t: t.startswith(LABEL)))
        .select(F.array_sort("antecedent").alias("tokens"), F.expr(f"substr(consequent[0], {len(LABEL) + 1})").alias("verdict"), "confidence", "support")
    )
    part = sure.select(
        F.col("tokens").alias("part"), F.col("tokens")[0].alias("token"), "verdict", F.col("confidence").alias("part_confidence")
    )
    weaker = (
        sure.filter(F.size("tokens") > 1).withColumn("token", F.explode("tokens")).join(part, ["token", "verdict"])
        .filter((F.col("part_confidence") >= F.col("confidence")) & (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
        .select("tokens", "verdict").distinct()
    )
    return sure.join(weaker, ["tokens", "verdict"], "left_anti")


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
    support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Per row: id, host, path, rule (null if none fits), verdict, block_confidence and allow_confidence of the mined rules.

    The list's verdicts are the labels.  FP-growth mines token combinations that go with block or allow; they
    judge the URLs no list rule fits: blocked if the surest matching block rule is surer than the surest
    matching allow rule.  Equal token sets are judged once: each set looks up its tokens in an inverted index, where a
    rule stands under its rarest token, and then checks the rule's other tokens.

    Defined cases: a null URL, or one without ``://``, has no host, path, tokens and rule, and is allowed; repeated rows are judged
    alike and each returned; an empty table gives no rows; without any listed URL nothing is mined; other columns are ignored.
    """
    parts = url_parts("url")
    known = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", *[c.alias(k) for k, c in parts.items()])
    known = cut_lineage(known.select("id", "host", "path", listed_rule(rules).alias("listed"), url_tokens().alias("tokens")))
    labelled = known.filter("listed is not null").select("tokens", F.col("listed.verdict").alias("verdict"))
    open_sets = known.filter("listed is null and size(tokens) > 0").select("tokens").distinct()
    if labelled.isEmpty():
        judged = open_sets.select("tokens", F.lit(None).cast("double").alias("block_confidence"), F.lit(None).cast("double").alias("allow_confidence"))
    else:
        mined = mine(labelled, support, confidence)
        often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
        index = (
            mined.withColumn("token", F.explode("tokens")).join(often, "token")
            .groupBy("tokens", "verdict", "confidence").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
            .withColumnRenamed("tokens", "needs")
        )
        judged = (
            open_sets.withColumn("token", F.explode("tokens")).join(index, "token")
            .filter(F.size(F.array_except("needs", "tokens")) == 0)
            .groupBy("tokens").agg(
                F.max(F.when(F.col("verdict") == "block", F.col("confidence"))).alias("block_confidence"),
                F.max(F.when(F.col("verdict") == "allow", F.col("confidence"))).alias("allow_confidence"),
            )
        )
    surer = F.coalesce(F.col("block_confidence") > F.coalesce("allow_confidence", F.lit(0.0)), F.lit(False))
    open_rows = known.filter("listed is null").join(judged, "tokens", "left")
    listed = known.filter("listed is not null")
    out = [F.col("id").alias(id_col), "host", "path"]
    none = F.lit(None).cast("double")
    return listed.select(
        *out, F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("verdict"), none.alias("block_confidence"), none.alias("allow_confidence")
    ).unionByName(
        open_rows.select(*out, F.lit(None).cast("string").alias("rule"), F.when(surer, "block").otherwise("allow").alias("verdict"), "block_confidence", "allow_confidence")
    )


SQL = r"""
with recursive a as (
  select page_id, coalesce(url, '') u, instr(coalesce(url, ''), '://') i from pages
), b as (
  select page_id, case when i > 0 then u[i + 3:] else '' end r, case when i > 0 then translate(u[:i - 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end scheme from a
), c as (
  select page_id, scheme, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path, regexp_extract(r, '^[^?#]*\?([^#]*)', 1) query, regexp_extract(r, '(?s)^[^#]*#(.*)', 1) fragment from b
), f as (
  select l.* from (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) l(rule, h, p, verdict)
), d as (
  select page_id, row_number() over () n, host, path, string_split(host, '.') l, scheme, query, fragment,
    (select max_by({'rule': rule, 'verdict': verdict}, length(rule)) from f where (host = h or host like '%.' || h) and starts_with(path, p)) listed from c
), t as (
  select n, page_id, host, path, listed, list_sort(list_distinct([x for x in
    ['tld:' || l[-1], 'domain:' || array_to_string(l[greatest(len(l) - 1, 1):], '.'), 'fragment:' || fragment, 'scheme:' || scheme]
    || ['sub:' || x for x in string_split(replace(array_to_string(l[:greatest(len(l) - 2, 0)], '.'), '-', '.'), '.')]
    || ['path:' || regexp_replace(x, '[0-9]+', '0', 'g') for x in string_split(path, '/')]
    || ['key:' || regexp_extract(x, '^[^=]*') for x in string_split(query, '&')] if not x like '%:' or x like '%:%:'])) tokens from d
), z as (
  select count(*) n from t where listed is not null
), y as (
  select tokens every, listed.verdict verdict, count(*) k from t where listed is not null group by 1, 2
), i as (
  select every, verdict, k, []::varchar[] tokens, 0::bigint place from y
  union all
  select every, verdict, k, list_append(tokens, every[p]), p from i, unnest(range(place + 1, len(every) + 1)) u(p)
), s as (
  select tokens, verdict, sum(k)::bigint k from i where len(tokens) > 0 group by 1, 2
), o as (
  select tokens, sum(k) k from s group by 1
), r as (
  select s.tokens, verdict, s.k::double / o.k confidence from s join o using (tokens), z where s.k >= ceil(0.01::double * z.n) and s.k::double / o.k >= 0.6
), m as (
  select * from r where len(tokens) = 1 or not exists (
    select 1 from r p where len(p.tokens) < len(r.tokens) and list_has_all(r.tokens, p.tokens) and p.verdict = r.verdict and p.confidence >= r.confidence)
), j as (
  select t.n, max(confidence) filter (m.verdict = 'block') block_confidence, max(confidence) filter (m.verdict = 'allow') allow_confidence
  from t join m on list_has_all(t.tokens, m.tokens) where listed is null group by 1
)
select page_id, host, path, listed.rule "rule", case when listed is not null then listed.verdict when block_confidence > coalesce(allow_confidence, 0) then 'block' else 'allow' end verdict,
  block_confidence, allow_confidence from t left join j using (n)
"""
