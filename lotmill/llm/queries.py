"""Queries of the training-data problems on the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotmill.functions.names import file_name, folded, picture, plain_lot, sql_file_name, sql_folded, sql_picture, sql_plain_lot
from lotmill.llm import cutoff, mixing, neighbours, overlap, packing, splits, truncation
from lotmill.llm.tokens import count_tokens
from lotmill.session import cut, table

TRAIN, EVALUATION = "bank", ["operation", "holdout"]


# 2 ---------------------------------------------------------------------------
def _overlaps(spark: SparkSession, sf_dir: str) -> overlap.Overlap:
    names = {"picture": picture(F.col("visa_source")), "file": file_name(F.col("image_path"))}
    rows = table(spark, sf_dir, "manifest").select("row_id", "visa_source", "image_path", "split")
    return overlap.overlaps(rows, F.col("row_id"), folded(F.col("split")), names, TRAIN, EVALUATION)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).pairs().select(F.least("train_id", "eval_id").alias("row_a"), F.greatest("train_id", "eval_id").alias("row_b"))


def p2_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and evaluation rows per split and source picture of the evaluation row, from counts; no pair is made."""
    per = _overlaps(spark, sf_dir).partners()
    name = F.translate(F.expr("substring(n0, 2, char_length(n0) - 2)"), overlap.SEP, "|").alias("picture")
    return per.groupBy("split", name).agg(F.sum("partners").alias("pairs"), F.count(F.lit(1)).alias("eval_rows"))


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many evaluation rows of each split have some or all of their names in the training split."""
    coverage = _overlaps(spark, sf_dir).coverage()
    part = F.count_if((F.col("held") > 0) & (F.col("held") < F.col("length")))
    return coverage.groupBy("split").agg(F.count(F.lit(1)).alias("eval_rows"), part.alias("covered_in_part"), F.count_if(F.col("held") == F.col("length")).alias("covered_whole"))


def p2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: characters of the evaluation rows' names, those within merged intervals that training texts hold, and the rows so covered to 80 % and wholly."""
    coverage = _overlaps(spark, sf_dir).coverage()
    near, full = F.count_if(F.col("covered") * 5 >= F.col("length") * 4), F.count_if(F.col("covered") == F.col("length"))
    return coverage.groupBy("split").agg(F.sum("length").alias("characters"), F.sum("covered").alias("covered"), near.alias("near_rows"), full.alias("whole_rows"))


_M = f"""with m as (select row_id, {sql_folded("split")} as split, 'picture|' || {sql_picture("visa_source")} as pic,
  {sql_file_name("image_path")} as fil from manifest),
p as (select a.row_id as train_id, b.row_id as eval_id, b.split, b.pic from m a join m b on a.pic = b.pic
      where a.split = 'bank' and b.split in ('operation', 'holdout')
      union select a.row_id, b.row_id, b.split, b.pic from m a join m b on a.fil = b.fil
      where a.split = 'bank' and b.split in ('operation', 'holdout'))
"""
_P2_FOUND = _M + "select least(train_id, eval_id) as row_a, greatest(train_id, eval_id) as row_b from p"
_P2_REPORT = _M + "select split, substr(pic, 9) as picture, count(*)::bigint as pairs, count(distinct eval_id) as eval_rows from p group by 1, 2"
_P2_COVERAGE = _M + """, k as (select split, pic is not null and pic in (select pic from m where split = 'bank' and pic is not null) as a, fil is not null and fil in (select fil from m where split = 'bank' and fil is not null) as b, pic is not null as ha, fil is not null as hb
  from m where split in ('operation', 'holdout') and (pic is not null or fil is not null))
select split, count(*) as eval_rows, count(*) filter ((a or b) and ((ha and not a) or (hb and not b))) as covered_in_part,
  count(*) filter ((a or not ha) and (b or not hb)) as covered_whole from k group by 1"""

_P2_SPANS = _M.split(",\np as")[0] + """,
n as (select row_id, split, string_split(replace(substr(pic, 9), '|', '/'), '/') as w from m where pic is not null union all select row_id, split, string_split(replace(fil, '|', '/'), '/') from m where fil is not null),
r as (select row_id, split, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from n where split in ('bank', 'operation', 'holdout')),
t as (select distinct w[i:i + 2] as run from r where split = 'bank'),
c as (select row_id, split, w, len(array_to_string(w, '/')) + 1 as length, list(i) as spots from r left join t on t.run = w[i:i + 2] where split <> 'bank' and t.run is not null group by all),
k as (select row_id, split, sum(len(array_to_string(w, '/')) + 1) as length from n where split in ('operation', 'holdout') group by all),
x as (select row_id, split, sum(list_sum(list_transform(range(1, len(w) + 1), lambda j: case when list_bool_or(list_transform(spots, lambda i: j >= i and j <= i + 2)) then len(w[j]) + 1 else 0 end))) as covered from c group by all)
select k.split, sum(length)::bigint as characters, coalesce(sum(covered), 0)::bigint as covered, count(*) filter (coalesce(covered, 0) * 5 >= length * 4) as near_rows, count(*) filter (covered = length) as whole_rows from k left join x using (row_id, split) group by 1"""


# 3 ---------------------------------------------------------------------------
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = table(spark, sf_dir, "bank_patches").select(folded(F.col("bank_version")).alias("bank_key"), F.col("vec_id").alias("near_id"), F.col("bank_row").alias("near_rank"), "embedding")
    queries = table(spark, sf_dir, "query_patches").select(folded(F.col("bank_version")).alias("bank_key"), F.col("vec_id").alias("query_id"), "embedding")
    return neighbours.nearest(bank, queries)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select(F.col("query_id").alias("vec_id"), F.col("near_id").alias("near_vec_id"))


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours as in ``matches``: place, distance and bank_row_index."""
    best = _nearest(spark, sf_dir)
    return best.select(F.col("query_id").alias("vec_id"), "place", F.round("distance", 6).alias("distance"), F.col("near_rank").alias("bank_row_index"))


_GOOD = "len(embedding) = 32 and not list_bool_or(list_transform(embedding, lambda v: v is null or isnan(v)))"
_KNN = f"""with b as (select {sql_folded("bank_version")} as k, vec_id, bank_row, embedding::double[] as e from bank_patches where {_GOOD}),
q as (select {sql_folded("bank_version")} as k, vec_id, embedding::double[] as e from query_patches where {_GOOD}),
r as (select q.vec_id, b.vec_id as near_vec_id, b.bank_row, list_distance(q.e, b.e) as d from q join b using (k)),
n as (select *, row_number() over (partition by vec_id order by d, bank_row, near_vec_id) as place from r)
"""
_P3_FOUND = _KNN + "select vec_id, near_vec_id from n where place <= 5"
_P3_MATCHES = _KNN + "select vec_id, place::int as place, round(d, 6) as distance, bank_row as bank_row_index from n where place <= 5"


# 4 ---------------------------------------------------------------------------
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "manifest").select(plain_lot(F.col("lot_id")).alias("entity"), picture(F.col("visa_source")).alias("tie"))
    links = cut(links.distinct()).where("entity is not null and tie is not null")  # filtered later, so that names are made out once
    _, roots = splits.spanning_forest(spark, splits.tie_edges(links))
    return roots.where("node <> root").select(F.col("root").alias("first_lot"), F.col("node").alias("lot_id"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest").select("row_id", "lot_id", "visa_source")
    return splits.groups(rows, F.col("row_id"), plain_lot(F.col("lot_id")), picture(F.col("visa_source")))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every row."""
    return _grouped(spark, sf_dir)


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [(r["split_name"], r["target_share"]) for r in table(spark, sf_dir, "split_targets").orderBy("split_name").collect()]  # a row a split
    return splits.deal(cut(_grouped(spark, sf_dir)), targets)


def p4_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir).select("row_id", "split_name")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shares_reached(_dealt(spark, sf_dir), table(spark, sf_dir, "split_targets"))


_P4_LOTS = f"""with recursive m as (select row_id, {sql_plain_lot("lot_id")} as lot, {sql_picture("visa_source")} as pic from manifest),
h as (select pic, min(lot) as hub from m where lot is not null and pic is not null group by pic),
e as (select distinct hub as a, lot as b from m join h using (pic) where lot is not null and lot <> hub),
u as (select a, b from e union select b, a from e),
c(lot, seen) as (select a, a from u union select c.lot, u.b from c join u on c.seen = u.a),
"""
_P4_FOUND = _P4_LOTS + "z as (select 1) select min(seen) as first_lot, lot as lot_id from c group by lot having min(seen) <> lot"
_P4_ROOTS = _P4_LOTS + """f as (select lot, min(seen) as root from c group by lot),
g as (select m.row_id, case when m.lot is not null then 'e:' || coalesce(f.root, m.lot) when m.pic is null then 'r:' || m.row_id::varchar when h.hub is null then 't:' || m.pic else 'e:' || coalesce(k.root, h.hub) end as root
  from m left join f on f.lot = m.lot left join h on h.pic = m.pic left join f k on k.lot = h.hub)
"""
_P4_GROUPS = _P4_ROOTS + "select row_id, root from g"
# the heads one by one in a recursion that carries what each split has got, the others along the order of the hash within their band
_P4_DEALT = _P4_ROOTS + """, s as (select root, count(*) as size, (length(bin(count(*))) - 1) as band, ('0x' || substr(md5('11|' || root), 1, 15))::ubigint as drawn from g group by root),
w as (select sum(size) as total, greatest(1, floor(sum(size) * 0.001::double)::bigint) as most from s),
t as (select list(split_name order by split_name) as names, list(target_share / (select sum(target_share) from split_targets) order by split_name) as shares from split_targets),
o as (select s.*, row_number() over (order by band desc, drawn, root) as i from s, w where size > most),
p(i, root, pick, got) as (select 0::bigint, null::varchar, 0::bigint, list_transform(names, lambda n: 0::bigint) from t
  union all select y.i, y.root, y.pick, list_transform(y.got, lambda v, j: v + case when j = y.pick then y.size else 0 end)
  from (select o.i, o.root, o.size, p.got, list_position(list_transform(shares, lambda v, j: v * total - p.got[j]), list_max(list_transform(shares, lambda v, j: v * total - p.got[j])))::bigint as pick from p join o on o.i = p.i + 1, w, t) y),
l as (select list_transform(shares, lambda v, j: greatest(0.0, v * total - got[j])) as open from (select got from p order by i desc limit 1), w, t),
a as (select root, (sum(size) over (partition by band order by drawn, root) - size / 2) / sum(size) over (partition by band) as pos from s, w where size <= most),
d as (select root, names[pick] as split_name from p, t where i > 0
  union all select root, names[least(len(names), 1 + len(list_filter(range(1, len(names)), lambda j: pos >= list_sum(open[1:j]) / list_sum(open))))] from a, t, l),
r as (select g.row_id, d.split_name, g.root from g join d using (root))
"""
_P4_ASSIGNMENT = _P4_DEALT + "select row_id, split_name from r"
_P4_SHARES = _P4_DEALT + "select b.split_name, b.target_share, count(r.root) as row_count, count(distinct r.root) as group_count, count(r.root) / (select count(*) from r) as reached_share from split_targets b left join r using (split_name) group by 1, 2"


# 5 ---------------------------------------------------------------------------
def _cutoffs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    results = table(spark, sf_dir, "inference_results").select("result_id", "image", "bank_version", "score", "scored_at")
    scored = cut(cutoff.latest(results, folded(F.col("bank_version")), F.col("image"), F.col("score"), F.col("scored_at"), F.col("result_id")))
    # a batch a month; with spark.lotmill.tree set the tree is kept there, and a later run replaces its own months
    tree = cutoff.CountTree(spark, spark.conf.get("spark.lotmill.tree", None)).add(scored, F.date_format("at", "yyyy-MM"))
    targets = table(spark, sf_dir, "keep_targets").select(folded(F.col("bank_version")).alias("source"), "keep_permille").where("source is not null")
    points = table(spark, sf_dir, "sweep_points").select(folded(F.col("bank_version")).alias("source"), "threshold").where("source is not null")
    return scored, cutoff.cutoffs(tree, scored, targets, points)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.kept(*_cutoffs(spark, sf_dir)).select(F.col("row_id").alias("result_id"))


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, chosen = _cutoffs(spark, sf_dir)
    chosen = cut(chosen)
    n = cutoff.kept(scored, chosen).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    out = chosen.join(n, "source", "left")
    return out.select(F.col("source").alias("bank_version"), "n", "keep_permille", "cutoff", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"))


_CUT = f"""with r as (select {sql_folded("bank_version")} as k, image, score, scored_at, result_id from inference_results
  where bank_version is not null and score is not null and score::varchar <> 'nan' and score >= 0),
l as (select * from (select *, row_number() over (partition by k, image order by scored_at desc nulls last, result_id desc) as rn from r) where rn = 1),
n as (select k, count(*) as n from l group by k),
t as (select {sql_folded("bank_version")} as k, keep_permille from keep_targets),
s as (select distinct {sql_folded("bank_version")} as k, threshold from sweep_points where threshold is not null and threshold::varchar <> 'nan'),
g as (select t.k, coalesce(n.n, 0) as n, t.keep_permille from t left join n using (k)),
o as (select s.k, s.threshold, count(l.k) as c from s left join l on l.k = s.k and l.score >= s.threshold group by 1, 2),
x as (select g.k, max(o.threshold) as cutoff from g join o using (k) where o.c * 1000 >= g.keep_permille * g.n group by g.k)
"""
_P5_FOUND = _CUT + "select result_id from l join x using (k) where score >= cutoff"
_P5_CUTOFFS = _CUT + """select g.k as bank_version, g.n, g.keep_permille, x.cutoff, count(l.k) as kept from g left join x using (k)
  left join l on l.k = g.k and l.score >= x.cutoff group by all"""


# 6, 7 ------------------------------------------------------------------------
def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cut(count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return packing.pack(items, table(spark, sf_dir, "pack_specs"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fills(_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing: all documents come out, no container is overfull, no text that fits is split, no token is lost."""
    items = cut(count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
    specs = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens")
    packed = cut(packing.pack(items, specs))
    docs = packed.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("held")).join(items, "doc_id").join(F.broadcast(specs), "spec_id")
    docs = docs.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens")))).alias("split_otherwise"), F.sum(F.col("tokens") - F.col("held")).alias("lost_tokens"))
    load = packed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("load")).join(F.broadcast(specs), "spec_id")
    load = load.groupBy("spec_id").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull"))
    return specs.join(docs, "spec_id").join(load, "spec_id").select("spec_id", "documents", "split_otherwise", "lost_tokens", "overfull")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", folded(F.col("source")).alias("source"), folded(F.col("lang")).alias("lang"), folded(F.col("object_name")).alias("domain"))
    targets = table(spark, sf_dir, "mix_targets").select(folded(F.col("source")).alias("source"), "target_weight", "max_repeat")
    return mixing.mix(cut(count_tokens(docs, keep=("doc_id", "source", "lang", "domain"))), targets)


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every mixture, by target source: documents on offer, and none used over its cap, twice in the list or for another source."""
    uses, shares = _mixed(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", folded(F.col("source")).alias("own"), (F.char_length("text") > 0).alias("full"))
    targets = table(spark, sf_dir, "mix_targets").select(folded(F.col("source")).alias("source"), "max_repeat")
    offer = docs.where("full").groupBy(F.col("own").alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    per = uses.groupBy("doc_id", "source").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("n")).join(docs, "doc_id").join(F.broadcast(targets), "source")
    bad = (F.col("uses") > F.col("max_repeat")) | (F.col("n") > 1) | (F.col("own") != F.col("source"))
    per = per.groupBy("source").agg(F.count_if(bad).alias("bad"))
    zero = F.lit(0).cast("bigint")
    out = shares.select("source").join(offer, "source", "left").join(per, "source", "left")
    return out.select("source", F.coalesce("documents", zero).alias("documents"), F.coalesce("bad", zero).alias("bad"))


# 8 ---------------------------------------------------------------------------
def _truncated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", folded(F.col("source")).alias("source"))
    return docs, truncation.truncated(docs)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir)[1].select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(*_truncated(spark, sf_dir))


def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each kind of evidence reports."""
    return _truncated(spark, sf_dir)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every report, by source: its documents, and none of those without text reported, or reported twice, or for another source."""
    docs, found = _truncated(spark, sf_dir)
    found = found.groupBy("doc_id", F.col("source").alias("said")).agg(F.count(F.lit(1)).alias("n"))
    both = docs.join(found, "doc_id", "left")
    bad = F.col("n").isNotNull() & ((F.coalesce(F.length(F.btrim("text")), F.lit(0)) == 0) | (F.col("n") > 1) | ~F.col("said").eqNullSafe(F.col("source")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(bad).alias("bad"))


_P6_INVARIANTS = "select spec_id, (select count(*) from documents) as documents, 0::bigint as split_otherwise, 0::bigint as lost_tokens, 0::bigint as overfull from pack_specs"
_P7_INVARIANTS = f"with d as (select {sql_folded('source')} as s, count(*) as n from documents where length(text) > 0 group by 1) select {sql_folded('t.source')} as source, coalesce(d.n, 0) as documents, 0::bigint as bad from mix_targets t left join d on d.s = {sql_folded('t.source')}"
_P8_INVARIANTS = f"select {sql_folded('source')} as source, count(*) as documents, 0::bigint as bad from documents group by 1"

QUERIES = {f.__name__: f for f in (p2_found, p2_overlap_report, p2_coverage, p2_spans, p3_found, p3_matches, p4_found, p4_groups, p4_assignment, p4_shares, p5_found, p5_cutoffs, p6_containers, p6_fill, p6_invariants, p7_uses, p7_shares, p7_invariants, p8_found, p8_rates, p8_reasons, p8_invariants)}
SQL = {
    "p2_found": _P2_FOUND,
    "p2_overlap_report": _P2_REPORT,
    "p2_coverage": _P2_COVERAGE,
    "p2_spans": _P2_SPANS,
    "p3_found": _P3_FOUND,
    "p3_matches": _P3_MATCHES,
    "p4_found": _P4_FOUND,
    "p4_groups": _P4_GROUPS,
    "p4_assignment": _P4_ASSIGNMENT,
    "p4_shares": _P4_SHARES,
    "p5_found": _P5_FOUND,
    "p5_cutoffs": _P5_CUTOFFS,
    "p6_invariants": _P6_INVARIANTS,
    "p7_invariants": _P7_INVARIANTS,
    "p8_invariants": _P8_INVARIANTS,
}
