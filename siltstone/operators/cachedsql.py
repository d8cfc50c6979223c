"""SQL over cached results: SELECT ... FROM view [WHERE] [GROUP BY] [ORDER BY] with a short list of functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from siltstone.lang.jexl import QueryError

# The functions that cached-result queries may use.
FUNCTIONS = {"COUNT", "SUM", "MIN", "MAX", "LOWER", "UPPER", "INET_ATON", "INET_NTOA", "CONVERT", "STR_TO_DATE"}
TOKEN = re.compile(r"\s+|'(?:[^']|'')*'|\d+(?:\.\d+)?|`[^`]+`|[A-Za-z_]\w*|<=|>=|<>|!=|[=<>+*/%(),.-]")
#: MySQL's format letters in Spark's.
LETTERS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%s": "ss", "%S": "ss", "%b": "MMM", "%M": "MMMM", "%T": "HH:mm:ss"}
KEYWORDS = {"AND", "OR", "NOT", "IN", "AS", "BETWEEN", "LIKE", "IS", "NULL", "TRUE", "FALSE", "DISTINCT", "ASC", "DESC"}
TYPES = {"SIGNED", "UNSIGNED", "CHAR", "DATE", "DATETIME", "DECIMAL", "DOUBLE", "FLOAT"}


def _translate(text: str) -> str:
    """Functions of the dialect in Spark SQL."""

    def octets(ip: str) -> str:
        return " + ".join(f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))

    arg = r"\(\s*((?:[^()]|\([^()]*\))*?)\s*\)"
    text = re.sub(rf"(?i)\bINET_ATON{arg}", lambda m: f"({octets(m[1])})", text)
    text = re.sub(rf"(?i)\bINET_NTOA{arg}", lambda m: "concat_ws('.', " + ", ".join(f"CAST(({m[1]}) div {256 ** (3 - i)} % 256 AS STRING)" for i in range(4)) + ")", text)
    text = re.sub(r"(?i)\bCONVERT\(\s*((?:[^()]|\([^()]*\))*?)\s*,\s*(\w+(?:\([\d, ]+\))?)\s*\)", lambda m: f"CAST({m[1]} AS { {'SIGNED': 'BIGINT', 'UNSIGNED': 'BIGINT', 'CHAR': 'STRING', 'DATETIME': 'TIMESTAMP'}.get(m[2].upper(), m[2]) })", text)

    def date(m: re.Match) -> str:
        pattern = m[2]
        for k, v in LETTERS.items():
            pattern = pattern.replace(k, v)
        return f"try_to_timestamp({m[1]}, '{pattern}')"

    return re.sub(r"(?i)\bSTR_TO_DATE\(\s*([^,()]+)\s*,\s*'([^']*)'\s*\)", date, text)


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or text.startswith("--", at):
            raise QueryError(f"not allowed: {text[at:]!r}")
        at = m.end()
        if not m[0].isspace():
            out.append(m[0])
    return out


def _check(text: str, columns: set[str], aliases: set[str], new: bool = False) -> str:
    """The part in Spark SQL, if it holds nothing but columns, literals, operators and the listed functions.

    ``aliases`` are the names that the selection gives, collected where a part may give ``new`` ones.
    """
    tokens = _tokens(text)
    if tokens.count("(") != tokens.count(")"):
        raise QueryError(f"parentheses don't match: {text!r}")
    for k, t in enumerate(tokens):
        word = t.strip("`").upper()
        following, before = tokens[k + 1] if k + 1 < len(tokens) else "", tokens[k - 1].upper() if k else ""
        if not re.match(r"[A-Za-z_`]", t):
            continue
        if following == "(" and word in FUNCTIONS and t[0] != "`":
            continue
        if before == "AS" and new:
            aliases.add(word)
        elif word in TYPES and before == ",":  # the type of a conversion
            continue
        elif following == "(" and word not in ("IN", "AND", "OR", "NOT", "BETWEEN", "DISTINCT") or word not in columns | aliases | KEYWORDS:
            raise QueryError(f"not a column, and not among the functions allowed: {t}")
    return _translate(text)


def cached_query(view: DataFrame, fields: str = "*", where: str = "", group_by: str = "", order_by: str = "") -> DataFrame:
    """A query in the restricted dialect over a result; parts are those of the SQL statement."""
    columns, aliases = {c.upper() for c in view.columns}, set()
    sql = f"SELECT {_check(fields, columns, aliases, True)} FROM {{view}}"
    for word, part in (("WHERE", where), ("GROUP BY", group_by), ("ORDER BY", order_by)):
        if part:
            sql += f" {word} {_check(part, columns, set() if word == 'WHERE' else aliases)}"
    return view.sparkSession.sql(sql, view=view)
