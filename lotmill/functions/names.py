"""Plain forms of the identifiers that arrive in several writings.

All are JVM-side column expressions. A null or meaningless value gives null, which names nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that counts as blank around labels.
BLANKS = " \t\n\r\f\u000b\u00a0"


def folded(c: Column) -> Column:
    """Trimmed and lower-cased, as splits, sources and bank versions are compared."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def plain_lot(c: Column) -> Column:
    """Upper case, letters and digits only; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", ""), F.lit(""))


def _path(c: Column) -> Column:
    """Lower case, one kind of slash, no repeated ones."""
    path = F.translate(F.lower(F.btrim(c, F.lit(BLANKS))), "\\", "/")
    return F.when(path.contains("//"), F.regexp_replace(path, "/+", "/")).otherwise(path)


def _shaped(path: Column, shape: str, to: str, empty: str) -> Column:
    """A path of that shape rewritten to ``to``, any other null; one match a path, as other paths match the whole and come out ``empty``."""
    return F.nullif(F.regexp_replace(path, rf"^(?:{shape})$|^(?s:.*)\z", to), F.lit(empty))


def picture(c: Column) -> Column:
    """``object|class|number`` of a source picture.

    Escapes are undone, both slashes and repeated slashes are one, the class is the last folder
    named good or bad, the object lies two folders above the class's content, the number is the
    first run of digits of the file name without leading zeros. Anything else names no picture.
    """
    path = _path(F.when(c.contains("%"), F.coalesce(F.try_url_decode(c), c)).otherwise(c))
    return _shaped(path, r"(?:.*/)?([^/]+)/[^/]+/(good|bad)/(?:.*/)?[^/0-9]*0*([0-9]+)[^/]*", "$1|$2|$3", "||")


def file_name(c: Column) -> Column:
    """``line/date/lot/stem``: the last four parts of a path; null if it has fewer or one of them is empty."""
    return _shaped(F.substring_index(_path(c), "/", -4), r"([^/]+/[^/]+/[^/]+/[^/]+?)(?:\.[^./]*)?", "$1", "")


#: The same expressions for DuckDB, as templates over one column.
SQL_BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)"


def sql_folded(c: str) -> str:
    return f"lower(trim({c}, {SQL_BLANKS}))"


def sql_plain_lot(c: str) -> str:
    return rf"nullif(regexp_replace(upper({c}), '[^\p{{L}}\p{{N}}]', '', 'g'), '')"


def _sql_path(c: str) -> str:
    return rf"regexp_replace(lower(trim({c}, {SQL_BLANKS})), '[\\/]+', '/', 'g')"


def sql_picture(c: str) -> str:
    path = _sql_path(f"url_decode({c})")
    shape = r"^(?:.*/)?([^/]+)/[^/]+/(good|bad)/(?:.*/)?[^/0-9]*0*([0-9]+)[^/]*$"
    return rf"case when regexp_matches({path}, '{shape}') then regexp_replace({path}, '{shape}', '\1|\2|\3') end"


def sql_file_name(c: str) -> str:
    path = _sql_path(c)
    shape = r"^(?:.*/)?([^/]+/[^/]+/[^/]+/[^/]+?)(?:\.[^./]*)?$"
    return rf"case when regexp_matches({path}, '{shape}') then regexp_replace({path}, '{shape}', '\1') end"
