"""Functions on identifiers, free text and model answers; JVM-side but for the automaton of terms."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmill.operators.skew import skew_join
from lotmill.session import cut


def bank_version(object_name: Column, line: Column) -> Column:
    """object-(last part of the line)-v1."""
    return F.concat(object_name, F.lit("-"), F.element_at(F.split(line, "_"), -1), F.lit("-v1"))


def next_version(version: Column) -> Column:
    """...vN becomes ...v(N+1), anything else gets -rebuilt."""
    n = F.regexp_extract(version, r"v(\d{1,9})$", 1)
    return F.when(n != "", F.concat(F.regexp_replace(version, r"\d+$", ""), (n.cast("int") + 1).cast("string"))).otherwise(F.concat(version, F.lit("-rebuilt")))


def folder_name(version: Column, at: Column, config: Column) -> Column:
    """version_yyyyMMdd-HHmm_(first 6 hex of the sha256 of the settings)."""
    return F.concat_ws("_", version, F.date_format(at, "yyyyMMdd-HHmm"), F.substring(F.sha2(config, 256), 1, 6))


def folder_parts(name: Column) -> Column:
    """Struct (version, built_at, config_id) of a folder name; null if it is none."""
    shape = r"^(.+)_(\d{8}-\d{4})_([0-9a-f]{6})$"
    part = lambda i: F.regexp_extract(name, shape, i)
    return F.when(name.rlike(shape), F.struct(part(1).alias("version"), F.try_to_timestamp(part(2), F.lit("yyyyMMdd-HHmm")).alias("built_at"), part(3).alias("config_id")))


def document_number(issue: Column, fallback: Column) -> Column:
    """APR- and the number part of an issue id, or six hex of the fallback's sha1."""
    n = F.regexp_extract(issue, r"-(\d+)$", 1)
    return F.concat(F.lit("APR-"), F.when(n != "", n).otherwise(F.substring(F.sha1(F.coalesce(fallback, F.lit(""))), 1, 6)))


def display_path(path: Column) -> Column:
    """The last two parts of a path."""
    return F.regexp_extract(path, r"(?:^|[/\\])([^/\\]+(?:[/\\][^/\\]+)?)$", 1)


def display_number(value: Column, digits: int = 4) -> Column:
    """Fixed digits; 'no record' for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), "no record").otherwise(F.format_string(f"%.{digits}f", value))


def product_ids(text: Column) -> Column:
    """The runs of letters, digits and - that begin with a letter, hold a digit, have at least two parts joined by single - and do not begin with LOT-; in order."""
    runs = F.split(text, "[^A-Za-z0-9-]+")
    return F.filter(runs, lambda x: x.rlike("^[A-Za-z]") & x.contains("-") & ~x.contains("--") & ~x.endswith("-") & x.rlike("[0-9]") & ~F.upper(x).startswith("LOT-"))


def is_identifier(c: Column) -> Column:
    return c.rlike(r"^[a-z][a-z0-9_]*$")


def line_name(c: Column) -> Column:
    """line_NN of the first number of at most three digits in a spoken line name; null without one."""
    n = F.regexp_extract(c, r"(\d{1,3})", 1)
    return F.when(n != "", F.format_string("line_%02d", n.cast("int")))


def stable_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the sha256 of the parts joined by ||, as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("||", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def error_code(defect: Column, codes: dict[str, str]) -> Column:
    """0000 for no defect, the table's code, else ESB and two digits of the defect's hash."""
    known = F.coalesce(*(F.when(defect == k, v) for k, v in codes.items()), F.lit(None).cast("string")) if codes else F.lit(None).cast("string")
    return F.when(defect.isNull(), "0000").otherwise(F.coalesce(known, F.format_string("ESB%02d", F.pmod(stable_hash(defect), F.lit(100).cast("decimal(20,0)")).cast("int"))))


def equipment_id(line: Column, *parts: Column) -> Column:
    """EQ-(line's last part)-(hash mod 4)."""
    return F.concat(F.lit("EQ-"), F.element_at(F.split(line, "_"), -1), F.lit("-"), F.pmod(stable_hash(line, *parts), F.lit(4).cast("decimal(20,0)")).cast("int").cast("string"))


def brace_span(text: Column) -> Column:
    """From the first { to the last } of a text, fences or not; {} if there is none."""
    first, last = F.instr(text, "{"), F.char_length(text) + 1 - F.instr(F.reverse(text), "}")
    found = (first > 0) & (last <= F.char_length(text)) & (last > first)
    return F.when(found, F.substring(text, first, last - first + 1)).otherwise(F.lit("{}"))


def lenient_json(text: Column, field: str) -> Column:
    """A field of the JSON object in a text as a string; null where there is no object, or no such field."""
    return F.get_json_object(brace_span(text), f"$.{field}")


def parsed_verdict(text: Column, allowed: list[str]) -> Column:
    """Struct (verdict, confidence) of a model's answer: a verdict that is not allowed is unknown, the confidence is kept within 0 and 1."""
    v = F.lower(F.trim(lenient_json(text, "verdict")))
    c = lenient_json(text, "confidence").try_cast("double")
    return F.struct(F.when(v.isin(*allowed), v).otherwise("unknown").alias("verdict"), F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).alias("confidence"))


def common_axis(verdict: Column, defect: list[str], normal: list[str]) -> Column:
    """Two vocabularies of verdicts on one: defect, normal, else withheld."""
    return F.when(verdict.isin(*defect), "defect").when(verdict.isin(*normal), "normal").otherwise("withheld")


def relative_path(path: Column, prefix: str) -> Column:
    """The path below a prefix; as it is if it does not lie there."""
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.char_length(path))).otherwise(path)


def rendered(value: Column) -> Column:
    """yes, no, or the value as text; 'no record' for null."""
    return F.coalesce(F.when(value.cast("string") == "true", "yes").when(value.cast("string") == "false", "no").otherwise(value.cast("string")), F.lit("no record"))


def match_terms(texts: DataFrame, vocabulary: DataFrame, ident: str, text: str, part_rows: int = 100_000) -> DataFrame:
    """``ident, term, stage`` of the best term for each text of (ident, text) that has one.

    ``vocabulary`` has (term, alias). Stage 1: the text equals the term, whatever the case; 2: it contains an alias;
    3: it contains the term. The lowest stage wins, then the longer match, then the lesser term. Each text is read once
    by an automaton of all terms and aliases, so its cost does not grow with their number. A vocabulary of over ``part_rows``
    rows is taken in parts of that size, one after the other, and texts are read once for each. ``ident`` is unique.
    """
    rows = vocabulary.where("term is not null").select("term", F.lower("term").alias("lt"), F.lower("alias").alias("la")).distinct()
    kind, out = dict(texts.dtypes)[ident], None
    texts = texts.select(ident, F.lower(F.col(text)).alias("__t")).where("__t is not null")
    listed = rows.orderBy("term", "la").toLocalIterator()
    while (part := [tuple(r) for r in islice(listed, part_rows)]) or out is None:

        def run(batches, part=part):
            import ahocorasick

            words: dict[str, list[tuple[int, int, str]]] = {}
            for term, lt, la in part:
                if la:
                    words.setdefault(la, []).append((2, -len(la), term))
                if lt:
                    words.setdefault(lt, []).append((3, -len(lt), term))
            automaton = ahocorasick.Automaton()
            for w, found in words.items():
                automaton.add_word(w, (w, min(found), [(1, n, t) for s, n, t in found if s == 3]))
            if words:
                automaton.make_automaton()
            for b in batches:
                ids, terms, stages, sizes = [], [], [], []
                for k, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    best = None
                    for _, (w, hit, whole) in automaton.iter(t) if words and t else ():
                        for x in (hit, min(whole) if whole and w == t else hit):
                            best = x if best is None or x < best else best
                    if best:
                        ids.append(k.as_py())
                        stages.append(best[0])
                        sizes.append(best[1])
                        terms.append(best[2])
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(stages, pa.int32()), pa.array(sizes, pa.int32()), pa.array(terms, pa.string())], [ident, "stage", "__l", "term"])

        one = texts.mapInArrow(run, f"`{ident}` {kind}, stage int, __l int, term string")
        # a part beyond the first is settled before the next is read, so the driver holds one at a time
        out = one if out is None else cut(out.unionAll(one).groupBy(ident).agg(F.min(F.struct("stage", "__l", "term")).alias("x")).select(ident, "x.*"))
    return out.select(ident, "term", "stage")


def similar(issues: DataFrame, probes: DataFrame, weights: dict[str, float], top: int = 5) -> DataFrame:
    """``probe_id, issue_id, similarity, matched_on, place``: the issues that share most weight with each probe.

    ``issues`` (issue_id, keys...), ``probes`` (probe_id, keys...). Equal non-empty keys add their weight; pairs that share
    none are left out. Order: similarity descending, then issue id; ``matched_on`` lists the keys in the order of the weights.

    An issue among the ``top`` of a probe is, for the set of keys that it shares with it, among the ``top`` least ids of those that
    share that set: any of these before it is as similar at least. So for each set of keys (2**keys - 1 of them) each combination
    of values keeps its ``top`` least issues, and a probe meets one row a set, however many issues share a key with it. Weights must be positive.
    """
    keys = list(weights)
    if min(weights.values()) <= 0:
        raise ValueError("weights are positive")
    sets = [[k for i, k in enumerate(keys) if n >> i & 1] for n in range(1, 2 ** len(keys))]

    def by_set(df: DataFrame) -> DataFrame:
        cells = [F.when(F.forall(F.array(*(F.col(k).cast("string") for k in s)), lambda v: F.coalesce(v != "", F.lit(False))), F.to_json(F.array(F.lit(str(i)), *(F.col(k).cast("string") for k in s)))) for i, s in enumerate(sets)]
        return df.withColumn("__key", F.explode(F.array_compact(F.array(*cells))))

    first = Window.partitionBy("__key").orderBy("issue_id")
    heads = by_set(issues.select("issue_id", *keys)).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= top)
    heads = cut(heads.groupBy("__key").agg(F.collect_list(F.struct("issue_id", *keys)).alias("__heads")))  # at most ``top``
    asked = by_set(probes.select("probe_id", *keys))
    met = skew_join(asked, heads, ["__key"], F.col("probe_id")).select("probe_id", *keys, F.explode("__heads").alias("__i"))
    same = {k: F.coalesce((F.col(k) != "") & (F.col(k) == F.col(f"__i.{k}")), F.lit(False)) for k in keys}
    score = F.round(sum((F.when(same[k], F.lit(float(w))).otherwise(0.0) for k, w in weights.items()), F.lit(0.0)), 4)
    on = F.array_join(F.array_compact(F.array(*(F.when(same[k], k) for k in keys))), ",")
    one = met.select("probe_id", F.col("__i.issue_id").alias("issue_id"), score.alias("similarity"), on.alias("matched_on")).distinct()
    place = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "issue_id"))
    return one.withColumn("place", place).where(F.col("place") <= top)
