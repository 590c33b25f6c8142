"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.llm import divergence, lattice, licenses, mixing, packing, pii, planes, quality, secrets, simhash, sites, urls, whitening
from motionspark.llm.common import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), blanks="dropped", end_id=1)
    return packed.drop("ids")


def op2_pii(spark, sf_dir):
    return pii.sanitise(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_site_bayes(spark, sf_dir):
    """The driver's documents have no URL: the source stands for the host and the language for the path."""
    return sites.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op5_token_planes(spark, sf_dir):
    path = f"{shared_folder(spark)}/planes-{uuid.uuid4().hex}"
    planes.write_planes(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), blanks="kept", end_id=0)
    return planes.document_digests(planes.read_planes(spark, path))


def op6_lattice(spark, sf_dir):
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.*")


def op8_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op10_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_licenses(spark, sf_dir):
    base = F.filter("spans", lambda s: s["phrase"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base)["first_word"].alias("first_word"), F.array_max(base)["first_word"].alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score",
    )


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def like(column: str, glob: str) -> str:
    """A glob as a regular expression: ``*`` before the first ``/`` stays in the host."""
    host, slash, rest = glob.partition("/")
    plain = lambda s, star: star.join("".join(c if c.isalnum() else f"[{c}]" for c in part) for part in s.split("*"))
    return f"regexp_full_match({column}, '{plain(host, '[^/]*')}{slash}{plain(rest, '(?s:.*)')}')"


def url_sql() -> str:
    rules = sorted(urls.SITE_RULES, key=lambda r: -len(r[1]))
    fits = lambda r: "(" + " or ".join(like("host || path", g) for g in (f"{r}*", f"*.{r}*")) + ")"
    rule = " ".join(f"when {fits(r)} then '{r}'" for _, r in rules)
    verdict = " ".join(f"when {fits(r)} then '{v}'" for v, r in rules)
    blocks = " or ".join(like("host || path || query", g) for v, g in urls.GLOB_RULES if v == "block")
    return f"""
with parts as (
  select page_id,
    translate(case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') else '' end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path,
    case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*[^?#]*([?][^#]+)', 1) else '' end as query
  from pages)
select page_id, host, path,
  case when host = '' then null {rule} end as rule,
  case when host = '' then 'allow' {verdict} when {blocks} then 'block' else 'allow' end as verdict
from parts"""


MIXING_SQL = """
with recursive n as (select source, count(*) as n from documents group by source),
r as (
  select source, source_rate, ceil(source_rate / 1000)::bigint as parts, source_rate / ceil(source_rate / 1000) as part_rate
  from (select source, round(1.0::double / (select count(*) from n) * (select count(*) from documents) / n, 9) as source_rate from n)),
pmf as (
  select source, source_rate, parts, part_rate, 0 as k, -part_rate as log_p, exp(-part_rate) as total from r
  union all
  select source, source_rate, parts, part_rate, k + 1, log_p + ln(part_rate) - ln((k + 1)::double), total + exp(log_p + ln(part_rate) - ln((k + 1)::double))
  from pmf where k < ceil(part_rate + 12 * sqrt(part_rate) + 30)),
cdf as (select source, source_rate, parts, list(round(total, 12)) as cdf from pmf group by source, source_rate, parts),
drawn as (
  select d.*, c.source_rate, c.cdf, list_transform(range(1, c.parts + 1), lambda i: ('0x' || substr(md5(
    'mix:' || coalesce(d.doc_id::varchar, '') || case when c.parts = 1 then '' else ':' || i || ':part' end), 1, 13))::bigint::double / 4503599627370496) as us
  from documents d join cdf c on d.source is not distinct from c.source),
counted as (select * exclude (us, cdf), list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda p: p <= u))))::int as copies from drawn),
many as (select *, unnest(range(copies))::int as copy from counted)
select *, md5('mix:' || coalesce(doc_id::varchar, '') || ':' || copy || ':order') as shuffle_key from many"""


def license_sql() -> str:
    """Votes of equal word triples by template and diagonal, neighbouring diagonals merged, and what they cover."""
    rows = []
    for i, t in enumerate(licenses.TEMPLATES):
        words = [w.decode() for w in licenses.words_of(t.text)]
        shift = 0 if t.phrase else max(licenses.SHIFT, len(words) // 10)
        rows.append(f"({i}, '{t.label}', {str(t.phrase).lower()}, {len(words)}, {shift}, {words})")
    return rf"""
with templates(template, label, phrase, size, shift, words) as (values {', '.join(rows)}),
known as (select template, label, phrase, size, shift, k as place, words[k + 1] || ' ' || words[k + 2] || ' ' || words[k + 3] as gram from (select *, unnest(range(size - 2)) as k from templates)),
docs as (select row_number() over () as row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
grams as (select row_id, k, w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] as gram from (select row_id, w, unnest(range(len(w) - 2)) as k from docs where len(w) >= 3)),
votes as (select row_id, template, label, phrase, size, shift, k - place as diagonal, place from grams join known using (gram)),
diagonals as (select distinct row_id, template, shift, diagonal from votes),
cuts as (select *, coalesce(diagonal - lag(diagonal) over (partition by row_id, template order by diagonal) > shift, false)::int as cut from diagonals),
parts as (select row_id, template, diagonal, sum(cut) over (partition by row_id, template order by diagonal) as part from cuts),
covered as (select v.row_id, v.template, label, phrase, size, part, unnest([place, place + 1, place + 2]) as word, v.diagonal + place as at_word from votes v join parts p on p.row_id = v.row_id and p.template = v.template and p.diagonal = v.diagonal),
spans as (select row_id, template, label, phrase, part, count(distinct word) / any_value(size) as coverage, min(at_word) as first_word from covered group by row_id, template, label, phrase, part),
taken as (select * from spans where coverage >= case when phrase then 1.0 else {licenses.COVERAGE} end),
summed as (select row_id, count(*) filter (phrase) as n_base, min(first_word) filter (phrase) as first_word, max(first_word) filter (phrase) as last_word, list_sort(list_distinct(coalesce(list(label) filter (phrase), []))) as base, list_sort(list_distinct(list(label))) as every from taken group by row_id),
scores as (select row_id, max(coverage) as score from spans group by row_id)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') as base_labels, coalesce(array_to_string(every, ','), '') as labels, coalesce(score, 0)::double as score
from docs left join summed using (row_id) left join scores using (row_id)"""


DIVERGENCE_SQL = r"""
with docs as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (select row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct row_id) >= 3),
v as (select lang, count(*) as v from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as c from words join kept using (lang, term) group by all),
n as (select lang, source, sum(c) as n from counts group by all),
lang_counts as (select lang, term, sum(c) as c from counts group by all),
lang_n as (select lang, sum(c) as n from lang_counts group by lang),
dense as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + ((1000000000 * (coalesce(c.c, 0) + 1)::hugeint) // (coalesce(n.n, 0) + v.v))::bigint as p
  from groups g join kept k on g.lang = k.lang join v on v.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term left join n on n.lang = g.lang and n.source = g.source),
summed as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
shares as (
  select d.lang, d.source, d.term, d.p, 1 + ((1000000000 * (l.c + 1)::hugeint) // (ln.n + v.v))::bigint as q
  from dense d join lang_counts l on d.lang = l.lang and d.term = l.term join lang_n ln on ln.lang = d.lang join v on v.lang = d.lang where d.c > 0),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from shares where p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 200"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_packing, op2_pii, op3_mixing, op4_site_bayes, op5_token_planes, op6_lattice, op7_url_filter, op8_quality, op9_simhash, op10_secrets, op11_licenses, op12_whitening, op13_divergence, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIXING_SQL, "op7_url_filter": url_sql(), "op11_licenses": license_sql(), "op13_divergence": DIVERGENCE_SQL}
