"""Guarded SQL over tables, and questions answered by rules that write SQL."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|replace|attach|detach|pragma|vacuum|truncate|merge|grant|revoke|set|refresh|load|msck|analyze|cache|uncache)\b", re.I)
_TEXT = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def identifier(name: str) -> str:
    """A name of letters, digits and underscores that does not begin with a digit."""
    clean = re.sub(r"\W+", "_", str(name).strip(), flags=re.ASCII).strip("_") or "col"
    return f"_{clean}" if clean[0].isdigit() else clean


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(plan) -> list:
    found, open_ = [], _each(plan.expressions())
    while open_:
        x = open_.pop()
        found.append(x)
        open_ += _each(x.children())
    return found


#: Leaves of an analysed plan that read no table.
_NO_TABLE = {"OneRowRelation", "OneRowRelation$", "LocalRelation", "CTERelationRef", "UnionLoopRef", "Range"}


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Views that a query reads, by the plan that Spark's own analysis gives, so names are resolved in their scope. It is an error
    (ValueError) to name a file, or a table by several parts, to read anything but a view, and to call Java by reflection."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parseQuery(sql)
    for named in re.findall(r"'UnresolvedRelation \[([^\]]+)\]", parsed.toString()):
        if "," in named or "." in named:
            raise ValueError(f"only plain table names are allowed, not {named}")
    used: set[str] = set()
    open_ = [spark.sql(sql)._jdf.queryExecution().analyzed()]
    while open_:
        x = open_.pop()
        for e in _expressions(x):
            if "Reflect" in _kind(e):
                raise ValueError("calls of Java methods are not allowed")
        open_ += _each(x.subqueries())
        if _kind(x) == "View":
            used.add(x.desc().identifier().table())
            continue
        below = _each(x.children())
        if not below and _kind(x) not in _NO_TABLE:
            raise ValueError(f"only registered tables may be read, not {_kind(x)}")
        open_ += below
    return used


def validated(spark: SparkSession, sql: str, tables: Iterable[str] | None = None) -> str:
    """The statement without a final semicolon, if it is one query (SELECT or WITH) over allowed tables; else ValueError."""
    clean = sql.strip().rstrip(";").strip()
    bare = _TEXT.sub(" ", clean)
    if not clean:
        raise ValueError("the statement is empty")
    if not re.match(r"^\(*\s*(select|with)\b", bare.strip(), re.I):
        raise ValueError("only SELECT and WITH statements are allowed")
    if m := _FORBIDDEN.search(bare):
        raise ValueError(f"{m[0].upper()} is not allowed")
    if ";" in bare:
        raise ValueError("only one statement is allowed")
    try:
        used = relations(spark, clean)
    except ValueError:
        raise
    except Exception as e:
        raise ValueError(f"the statement can't be parsed: {str(e).splitlines()[0]}") from e
    if tables is not None and (unknown := sorted(used - set(tables))):
        raise ValueError(f"tables that may not be read: {unknown}")
    return clean


def run_sql(spark: SparkSession, sql: str, tables: Iterable[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """The result of a guarded query; with max_rows at most so many rows, for answers shown to a user."""
    out = spark.sql(validated(spark, sql, tables))
    return out if max_rows is None else out.limit(max_rows)


def register(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> list[str]:
    """Parquet tables of a folder as temporary views."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return list(names)


def table_from_records(spark: SparkSession, name: str, records: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Records with any keys as a view: columns in order of first appearance, BIGINT, DOUBLE or STRING by their values; nested values as JSON."""
    import json

    rows = [dict(r) for r in records]
    columns = list(dict.fromkeys(k for r in rows for k in r)) or ["id"]

    def kind(values: list) -> T.DataType:
        known = [v for v in values if v not in (None, "")]
        for t, spark_type in ((int, T.LongType()), (float, T.DoubleType())):
            try:
                if known and all(not isinstance(v, bool) and (t(v) is not None) and (t is float or not isinstance(v, float)) for v in known):
                    return spark_type
            except (TypeError, ValueError):
                pass
        return T.LongType() if not rows else T.StringType()

    def value(v: Any, t: T.DataType):
        if v is None or v == "" and not isinstance(t, T.StringType):
            return None
        if isinstance(t, T.LongType):
            return int(v)
        if isinstance(t, T.DoubleType):
            return float(v)
        return json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list, tuple, set)) else str(v)

    kinds = [kind([r.get(c) for r in rows]) for c in columns]
    schema = T.StructType([T.StructField(identifier(c), t) for c, t in zip(columns, kinds, strict=True)])
    df = spark.createDataFrame([tuple(value(r.get(c), t) for c, t in zip(columns, kinds, strict=True)) for r in rows], schema)
    df.createOrReplaceTempView(identifier(name))
    return df


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[str, ...]
    numeric: frozenset[str]


def schema_of(spark: SparkSession, names: Iterable[str]) -> list[Table]:
    out = []
    for n in sorted(names):
        fields = spark.table(n).schema.fields
        out.append(Table(n, tuple(f.name for f in fields), frozenset(f.name for f in fields if isinstance(f.dataType, T.NumericType))))
    return out


ALIASES = ({"ca", "chiffre", "revenu", "revenue", "ventes", "sales", "montant"}, {"client", "customer", "nom", "name"}, {"score", "note", "rating"})


def _mentions(q: str, column: str) -> bool:
    c = column.lower()
    return c in q or c.replace("_", " ") in q or any(c in group and any(a in q for a in group) for group in ALIASES)


def question_to_sql(question: str, tables: list[Table]) -> tuple[str, float]:
    """(SQL, confidence) by keywords, tested in this order: count, sum, average, maximum, minimum, all rows."""
    if not tables:
        raise ValueError("no tables")
    q = question.lower()
    table = max(tables, key=lambda t: sum(x.lower() in q for x in (t.name, *t.columns)))
    numeric = [c for c in table.columns if c in table.numeric]
    column = next((c for c in numeric if _mentions(q, c)), numeric[0] if numeric else table.columns[0])
    where = ""
    for c in table.columns:
        if m := re.search(rf"\b{re.escape(c.lower())}\s*(?:est|=|equals|vaut)\s*['\"]?([\w .-]+?)['\"]?\s*[?.]?$", q):
            where = f" WHERE lower(cast(`{c}` AS STRING)) = '{m[1].strip()}'"
            break
    has = lambda *marks: any(m in q for m in marks)
    if has("combien", "nombre", "count", "how many"):
        return f"SELECT count(*) AS count FROM `{table.name}`{where}", 0.75
    if has("total", "somme", "sum"):
        return f"SELECT sum(`{column}`) AS `total_{column}` FROM `{table.name}`{where}", 0.72
    if has("moyenne", "average", "avg"):
        return f"SELECT avg(`{column}`) AS `average_{column}` FROM `{table.name}`{where}", 0.72
    if has("max", "plus grand", "plus gros", "le plus", "highest", "top"):
        return f"SELECT * FROM `{table.name}`{where} ORDER BY `{column}` DESC", 0.68
    if has("min", "plus petit", "lowest"):
        return f"SELECT * FROM `{table.name}`{where} ORDER BY `{column}` ASC", 0.68
    return f"SELECT * FROM `{table.name}`{where}", 0.55


def sql_in(answer: str) -> str:
    """The SQL of a model's answer: a fenced block, else from the first line that begins with SELECT or WITH."""
    if m := re.search(r"```(?:sql)?\s*(.*?)```", answer, flags=re.I | re.S):
        return m[1].strip()
    m = re.search(r"^\s*((?:select|with)\b.*)", answer, flags=re.I | re.S | re.M)
    return (m[1] if m else answer).strip()


def ask(spark: SparkSession, question: str, names: Iterable[str], max_rows: int = 50, generate=None) -> tuple[DataFrame, dict]:
    """(rows, how): the answer to a question over tables. generate (prompt -> text) may write the SQL; if it is refused, the rules do, with a warning."""
    names = list(names)
    tables, warnings = schema_of(spark, names), []
    if generate is not None:
        prompt = "Write one read-only SQL query.\n" + "\n".join(f"- {t.name}({', '.join(t.columns)})" for t in tables) + f"\nQuestion: {question}\nSQL:"
        try:
            sql = validated(spark, sql_in(generate(prompt)), names)
            return run_sql(spark, sql, names, max_rows), {"sql": sql, "method": "generated", "confidence": 0.65, "warnings": warnings}
        except ValueError as e:
            warnings.append(f"generated SQL refused: {e}")
    sql, confidence = question_to_sql(question, tables)
    return run_sql(spark, sql, names, max_rows), {"sql": sql, "method": "rules", "confidence": confidence, "warnings": warnings}
