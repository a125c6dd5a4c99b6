"""Generation requests: parameter parsing and layering, templates, routing, choices.

Where a request can be refused, the operator returns (accepted, rejected) and
the rejected rows carry ``reason`` as "Type: message"; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: texts that read as an integer or a float.
INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
FLOAT_TEXT = (
    r"(?i)^\s*[+-]?("
    r"([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?"
    r"|inf|infinity|nan)\s*$"
)

# Configuration entries that act as parameters.
CONFIG_PARAMS = {"canvas.width": "width", "canvas.height": "height", "normal.enabled": "normal"}


def parse_params(pairs: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``name=value`` texts to name, type (bool, int, float, string) and value.

    Split at the first "="; a text without one is rejected. ``value`` is the
    text (booleans in lower case); int_value and float_value hold the numbers.
    """
    text = F.col(column)
    has_equals = F.coalesce(F.contains(text, F.lit("=")), F.lit(False))
    at = F.instr(text, "=")
    value = F.substring(text, at + 1, F.length(text))
    kind = (
        F.when(F.lower(F.col("value")).isin("true", "false"), "bool")
        .when(F.col("value").rlike(INT_TEXT), "int")
        .when(F.col("value").rlike(FLOAT_TEXT), "float")
        .otherwise("string")
    )
    digits = F.regexp_replace(F.trim("value"), "_", "")
    parsed = (
        pairs.filter(has_equals)
        .withColumns({"name": F.substring(text, F.lit(1), at - 1), "value": value})
        .withColumn("type", kind)
        .withColumns(
            {
                "int_value": F.when(F.col("type") == "int", digits.try_cast("bigint")),
                "float_value": F.when(F.col("type") == "float", digits.try_cast("double")),
                "value": F.when(F.col("type") == "bool", F.lower("value")).otherwise(F.col("value")),
            }
        )
    )
    rejected = pairs.filter(~has_equals).withColumn(
        "reason", F.concat(F.lit("ValueError: expected k=v, got "), F.coalesce(text, F.lit("null")))
    )
    return parsed, rejected


def route(requests: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give each request the first adapter, by priority, that serves its (op, model).

    The preference is settled on the model listing first, so requests need one
    equi-join and no ranking; requests nobody serves are rejected, never
    rerouted. A hot (model, op) is no problem while the listing is broadcast by
    size, and AQE splits it beyond that.
    """
    served = (
        models.select("adapter", "priority", "model_id", F.explode("ops").alias("op"))
        .groupBy("model_id", "op")
        .agg(F.min_by("adapter", F.struct("priority", "adapter")).alias("adapter"))
    )
    matched = requests.join(served, ["model_id", "op"], "left")
    routed = matched.filter(F.col("adapter").isNotNull())
    rejected = (
        matched.filter(F.col("adapter").isNull())
        .drop("adapter")
        .withColumn(
            "reason",
            F.format_string("LookupError: no adapter serves op='%s' model_id='%s'", "op", "model_id"),
        )
    )
    return routed, rejected


def config_params(config: Mapping[str, str | None]) -> dict[str, str | None]:
    """The parameters that a workspace configuration sets, by parameter name."""
    return {CONFIG_PARAMS[name]: value for name, value in config.items() if name in CONFIG_PARAMS}


def resolve_params(
    requests: DataFrame, declared: DataFrame, config: Mapping[str, str | None]
) -> DataFrame:
    """Effective parameters of each request as the map column ``params``.

    ``requests`` has scope_id and the map ``overrides``; ``declared`` has
    scope_id, name, type, default_value. For a declared name the caller's value
    wins over the configuration, which wins over the default; presence decides,
    so an explicit null override stays. Undeclared overrides pass through,
    undeclared configuration does not. The declarations of a scope are one
    array row, so a request is one row before and after. The scope is joined as
    an exploded value: a scope that is one literal for all requests would be
    folded into the condition, and a join without a key pairs all rows. The
    declarations, a list of settings, are broadcast, so requests stay in place.
    """
    per_scope = declared.groupBy("scope_id").agg(
        F.sort_array(F.collect_list(F.struct("name", "type", "default_value"))).alias("declared")
    )
    literal = [c for k, v in config.items() for c in (F.lit(k), F.lit(v).cast("string"))]
    settings = F.create_map(*literal) if literal else F.create_map().cast("map<string,string>")
    given = F.coalesce(F.col("overrides"), F.create_map().cast("map<string,string>"))

    def layered(one: Column) -> Column:
        name = one["name"]
        return F.struct(
            name.alias("key"),
            F.when(F.map_contains_key(given, name), given[name])
            .when(F.map_contains_key(settings, name), settings[name])
            .otherwise(one["default_value"])
            .alias("value"),
        )

    none = F.array().cast("array<struct<name:string,type:string,default_value:string>>")
    scoped = requests.withColumn("_scope", F.explode(F.array("scope_id")))
    joined = scoped.join(F.broadcast(per_scope.withColumnRenamed("scope_id", "_scope")), "_scope", "left").drop("_scope")
    joined = joined.withColumn("declared", F.coalesce("declared", none))
    names = F.transform("declared", lambda one: one["name"])
    return joined.withColumn(
        "params",
        F.map_concat(
            F.map_from_entries(F.transform("declared", layered)),
            F.map_filter(given, lambda k, _: ~F.array_contains(names, k)),
        ),
    ).drop("declared")


def typed_params(resolved: DataFrame, declared: DataFrame) -> DataFrame:
    """Long form of ``params`` with the declared type (null for pass-through names)."""
    long = resolved.select("request_id", "scope_id", F.explode("params").alias("name", "value"))
    types = declared.select("scope_id", "name", "type")
    return long.join(types, ["scope_id", "name"], "left")


def integer_params(
    resolved: DataFrame, ranges: Mapping[str, tuple[int, int]], params: str = "params"
) -> tuple[DataFrame, DataFrame]:
    """Each named parameter as an integer column of its request: (accepted, rejected).

    ``ranges`` gives the least and greatest value of each name. A request whose
    parameter is missing, null, no integer or out of its range is rejected; the
    reason names all such parameters, in the order of ``ranges``.
    """
    given = F.coalesce(F.col(params), F.create_map().cast("map<string,string>"))

    def read(given: Column) -> Column:
        values = {
            name: F.when(F.rlike(given[name], F.lit(INT_TEXT)), F.regexp_replace(F.trim(given[name]), "_", "").try_cast("bigint"))
            for name in ranges
        }
        wrong = F.array_compact(F.array(*(
            F.when(~F.coalesce(values[name].between(low, high), F.lit(False)), F.concat(F.lit(f"{name}="), F.coalesce(given[name], F.lit("null"))))
            for name, (low, high) in ranges.items()
        )))
        return F.struct(*(v.alias(n) for n, v in values.items()), wrong.alias("_wrong"))

    # read in a lambda: the map, itself an expression, is made once for all its names
    judged = resolved.withColumn("_read", F.get(F.transform(F.array(given), read), F.lit(0)))
    fine = F.size("_read._wrong") == 0
    accepted = judged.filter(fine).withColumns({n: F.col("_read")[n].cast("int") for n in ranges}).drop("_read")
    reason = F.concat(F.lit("ValueError: not usable: "), F.array_join("_read._wrong", ", "))
    return accepted, judged.filter(~fine).withColumn("reason", reason).drop("_read")


def _is_placeholder(value: Column) -> Column:
    return F.startswith(value, F.lit("${")) & F.endswith(value, F.lit("}"))


def _placeholder_name(value: Column) -> Column:
    return F.substring(value, F.lit(3), F.length(value) - 3)


def _fill(value: Column, kind: T.DataType, params: Column) -> Column:
    if isinstance(kind, T.StringType):
        return F.when(_is_placeholder(value), params[_placeholder_name(value)]).otherwise(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda one: _fill(one, kind.elementType, params))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, one: _fill(one, kind.valueType, params))
    if isinstance(kind, T.StructType):
        fields = [_fill(value[f.name], f.dataType, params).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _strings(value: Column, kind: T.DataType) -> Column:
    """All strings inside a nested value, as one array."""
    empty = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.array(value)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda one: _strings(one, kind.elementType))
        return F.coalesce(F.flatten(inner), empty)
    if isinstance(kind, T.MapType):
        inner = F.transform(F.map_values(value), lambda one: _strings(one, kind.valueType))
        return F.coalesce(F.flatten(inner), empty)
    if isinstance(kind, T.StructType):
        parts = [F.coalesce(_strings(value[f.name], f.dataType), empty) for f in kind.fields]
        return F.concat(*parts) if parts else empty
    return empty


def fill_templates(rows: DataFrame, column: str, params: str = "params") -> tuple[DataFrame, DataFrame]:
    """Replace every string that is exactly ``${name}`` by ``params[name]``.

    Follows the schema of ``column`` through structs, arrays and maps. A string
    that merely contains a placeholder stays. Rows that name an undefined
    parameter are rejected.
    """
    kind = rows.schema[column].dataType
    given = F.coalesce(F.col(params), F.create_map().cast("map<string,string>"))
    wanted = F.transform(
        F.filter(_strings(F.col(column), kind), _is_placeholder), _placeholder_name
    )
    undefined = F.array_sort(F.array_distinct(F.array_except(wanted, F.map_keys(given))))
    judged = rows.withColumn("undefined", undefined)
    filled = judged.filter(F.size("undefined") == 0).withColumn(
        column, _fill(F.col(column), kind, given)
    )
    rejected = judged.filter(F.size("undefined") > 0).withColumn(
        "reason",
        F.concat(F.lit("KeyError: undefined param "), F.array_join("undefined", ", ")),
    )
    return filled.drop("undefined"), rejected.drop("undefined")


# A JSON string that is one placeholder, in a place where a value can stand.
PLACEHOLDER = r'(?<!\\)"\$\{([^"\\]*)\}"(?=[,\]}]|$)'


def json_params(params: Column, types: Column) -> Column:
    """A map of parameter texts as a map of JSON values, by the declared type of each name.

    int and float texts become numbers and bool texts true or false; a text that
    does not read as its type, and a name without a type, become strings. Null
    becomes null.
    """

    def value(name: Column, text: Column) -> Column:
        kind = F.coalesce(F.try_element_at(types, name), F.lit("string"))
        string = F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)
        return (
            F.when(text.isNull(), F.lit("null"))
            .when((kind == "int") & text.try_cast("bigint").isNotNull(), text.try_cast("bigint").cast("string"))
            .when((kind == "float") & text.try_cast("double").isNotNull() & text.rlike("[0-9]"), F.to_json(F.parse_json(F.trim(text))))
            .when((kind == "bool") & F.lower(text).isin("true", "false"), F.lower(text))
            .otherwise(string)
        )

    return F.transform_values(params, value)


def fill_json(rows: DataFrame, column: str, params: str = "params") -> tuple[DataFrame, DataFrame]:
    """Replace every JSON string that is exactly ``"${name}"`` by the value of that parameter, type and all.

    ``column`` is a JSON text of any nesting and ``params`` a map of JSON texts
    (``json_params``). The result is a variant: a number stays a number, an
    object becomes part of the tree. Keys, and strings that merely contain a
    placeholder, stay. Rows that name an undefined parameter, or are no JSON,
    are rejected; a null text stays null.
    """
    given = F.coalesce(F.col(params), F.create_map().cast("map<string,string>"))
    parsed = F.try_parse_json(F.col(column))
    names = F.array_distinct(F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(PLACEHOLDER), F.lit(1)))
    judged = rows.withColumn("_text", F.to_json(parsed)).withColumn("_names", names).withColumn(
        "_undefined", F.array_sort(F.array_except("_names", F.map_keys(given)))
    )

    def put(text: Column, name: Column) -> Column:
        pattern = F.concat(F.lit(r'(?<!\\)"\$\{\Q'), name, F.lit(r'\E\}"(?=[,\]}]|$)'))
        literal = F.regexp_replace(F.coalesce(given[name], F.lit("null")), r"([\\$])", r"\\$1")
        return F.regexp_replace(text, pattern, literal)

    broken = F.col(column).isNotNull() & F.col("_text").isNull()
    bad = broken | (F.size("_undefined") > 0)
    filled = judged.filter(~bad).withColumn(column, F.parse_json(F.aggregate("_names", F.col("_text"), put)))
    reason = F.when(broken, F.lit("ValueError: no JSON")).otherwise(
        F.concat(F.lit("KeyError: undefined param "), F.array_join("_undefined", ", "))
    )
    rejected = judged.filter(bad).withColumn("reason", reason)
    own = ("_text", "_names", "_undefined")
    return filled.drop(*own), rejected.drop(*own)


def choose_candidates(nodes: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The picked candidate of each (run, node), else its first one.

    ``nodes`` (run_id, node_id, candidates), ``choices`` (run_id, node_id,
    pick). A pick outside the candidates is rejected.
    """
    picked = nodes.join(choices.select("run_id", "node_id", "pick"), ["run_id", "node_id"], "left")
    chosen = picked.withColumn("chosen", F.coalesce("pick", F.get("candidates", F.lit(0))))
    valid = F.coalesce(F.array_contains("candidates", F.col("chosen")), F.lit(False))
    accepted = chosen.filter(valid).drop("pick")
    rejected = chosen.filter(~valid).withColumn(
        "reason", F.format_string("KeyError: task node %s: '%s' is not a candidate", "node_id", "chosen")
    )
    return accepted, rejected.drop("pick")


def first_output(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``output``: the first entry of ``outputs``; empty or missing outputs are rejected."""
    some = F.coalesce(F.size("outputs"), F.lit(0)) > 0
    taken = results.filter(some).withColumn("output", F.get("outputs", F.lit(0)))
    rejected = results.filter(~some).withColumn(
        "reason", F.lit("ValueError: the result has no output")
    )
    return taken, rejected
