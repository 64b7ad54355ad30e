"""JSON request lines to typed transactions, with a dead-letter side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.schemas import CHANNELS, REQUEST, REQUIRED

# Forms of an id that are accepted; all are brought to the hyphenated one in lower case.
_PLAIN = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_UUID = f"^([0-9a-fA-F]{{32}}|{_PLAIN}|[{{]{_PLAIN}[}}]|urn:uuid:{_PLAIN})$"


def json_kind(doc: str, path: str) -> str:
    """SQL for the JSON kind at a path: STRING, BIGINT, DECIMAL(p,s), VOID, ... or null."""
    return f"schema_of_variant(variant_get({doc}, '$.{path}', 'variant'))"


def _kind(name: str, kind: str) -> str:
    """The kind of a field. An integer that fits is a BIGINT; a whole decimal that would
    fit was written with a fraction, so it is no integer."""
    if kind not in ("bigint", "int"):
        return json_kind("_doc", name)
    fits = f"try_variant_get(_doc, '$.{name}', 'bigint') IS NOT NULL"
    found = json_kind("_doc", name)
    return f"CASE WHEN {found} LIKE 'DECIMAL%' AND {fits} THEN 'FRACTION' ELSE {found} END"


def decode_requests(raw: DataFrame, value: str = "value") -> DataFrame:
    """Adds the request columns and `cause`: null when the line keeps the contract.

    Each line is parsed once. Values of the wrong JSON kind are not converted:
    a number is no string and a string no number. Unknown fields are ignored.

    All values are read by one cast of the document, and one look at the document's shape
    passes most lines; only the others have the kinds of their fields looked up one by one.
    """
    kinds = ", ".join(f"coalesce({_kind(f.name, f.dataType.simpleString())}, 'VOID')" for f in REQUEST.fields)
    names = REQUEST.names
    typed = (
        raw.withColumn("_doc", F.try_parse_json(value))
        .select(
            *raw.columns,
            "_doc",
            F.expr(f"try_variant_get(_doc, '$', '{REQUEST.simpleString()}')").alias("_typed"),
            F.coalesce(F.schema_of_variant("_doc").rlike(_SHAPE), F.lit(False)).alias("_plain"),
        )
        .select(
            *raw.columns,
            F.expr(f"CASE WHEN NOT _plain THEN array({kinds}) END").alias("_kinds"),
            F.col("_doc").isNull().alias("_broken"),
            "_typed.*",
        )
    )
    # A generator keeps later filters on `cause` above it, so that they read the
    # verdict instead of repeating the parsing in the filter.
    judged = F.array(F.struct(F.expr(_cause()).alias("cause"), *names))
    out = typed.select(*raw.columns, F.inline(judged).alias("cause", *names))
    valid = {c: f"CASE WHEN cause IS NULL THEN {c} END" for c in names}
    digits = "lower(replace(replace(replace(replace(trace_id, 'urn:uuid:', ''), '-', ''), '{', ''), '}', ''))"
    groups = "^(.{8})(.{4})(.{4})(.{4})(.{12})$"
    valid["trace_id"] = f"CASE WHEN cause IS NULL THEN regexp_replace({digits}, '{groups}', '$1-$2-$3-$4-$5') END"
    return out.select(*raw.columns, "cause", *[F.expr(e).alias(c) for c, e in valid.items()])


# JSON kinds a column accepts; whole decimals are integers too long for BIGINT.
_NUMBER = ("BIGINT", "WHOLE", "DECIMAL", "DOUBLE", "FLOAT")
_KINDS = {
    "bigint": ("BIGINT", "WHOLE"),
    "int": ("BIGINT", "WHOLE"),
    "double": _NUMBER,
    "boolean": ("BOOLEAN",),
    "string": ("STRING",),
}


_SPELLED = {
    "bigint": "BIGINT",
    "int": "BIGINT",
    "double": r"(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\))",
    "boolean": "BOOLEAN",
    "string": "STRING",
}


def _shape() -> str:
    """Pattern of the shape of a document with all fields in their kinds and no others."""
    kinds = {f.name: _SPELLED[f.dataType.simpleString()] for f in REQUEST.fields}
    parts = [
        f"{name}: {kinds[name]}" if name in REQUIRED else f"({name}: ({kinds[name]}|VOID), )?"
        for name in sorted(kinds)
    ]
    # An optional field brings its own comma along; the last field is a required one.
    return "^OBJECT<" + ", ".join(parts).replace(")?, ", ")?") + ">$"


_SHAPE = _shape()


def _cause() -> str:
    """First broken rule: kinds of the fields in their order, then ranges and values."""

    types = {f.name: f.dataType.simpleString() for f in REQUEST.fields}
    rules = ", ".join(
        f"struct('{name}' AS name, {name in REQUIRED} AS required, "
        f"array({', '.join(map(repr, _KINDS[kind]))}) AS kinds)"
        for name, kind in types.items()
    )
    plain = (
        "CASE WHEN k LIKE 'DECIMAL%,0)' THEN 'WHOLE' WHEN k LIKE 'DECIMAL%' THEN 'DECIMAL' ELSE k END"
    )
    # One small lambda over all fields keeps the generated code short.
    verdicts = (
        f"zip_with(_kinds, array({rules}), (k, rule) -> CASE "
        "WHEN k = 'VOID' THEN CASE WHEN rule.required THEN concat('missing: ', rule.name) END "
        f"WHEN NOT array_contains(rule.kinds, {plain}) THEN concat('type: ', rule.name) END)"
    )
    # Lines of the plain shape have no kinds looked up and come out without a verdict here.
    first = f"try_element_at(filter({verdicts}, v -> v IS NOT NULL), 1)"
    ranges = " ".join(
        f"WHEN {name} IS NULL THEN 'range: {name}'"
        for name, kind in types.items()
        if kind in ("bigint", "int")
    )
    ranges += " WHEN abs(amount) = double('infinity') THEN 'range: amount'"
    channels = ", ".join(map(repr, CHANNELS))
    values = (
        f"CASE {ranges} WHEN channel NOT IN ({channels}) THEN 'channel' "
        f"WHEN NOT trace_id RLIKE '{_UUID}' THEN 'trace_id' END"
    )
    return f"CASE WHEN _broken THEN 'syntax' ELSE coalesce({first}, {values}) END"


def dead_letter_split(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid transactions, dead letters with their cause)."""
    names = [f.name for f in REQUEST.fields]
    valid = decoded.filter(F.col("cause").isNull()).drop("cause")
    dead = decoded.filter(F.col("cause").isNotNull()).drop(*names)
    return valid, dead


def encode_requests(tx: DataFrame) -> DataFrame:
    """Transactions as JSON lines in the request form; other columns stay columns."""
    names = [f.name for f in REQUEST.fields if f.name in tx.columns]
    rest = [c for c in tx.columns if c not in names]
    return tx.select(*rest, F.to_json(F.struct(*names)).alias("value"))
