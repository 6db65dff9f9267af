"""Whole entities as an API returns them: scalars, names for codes, parsed JSON, children as arrays of structs in order.

Children are gathered per inspection, which has a handful. JSON that is missing or broken gives what its column's default says. Keys of JSON objects
are in camel case.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes a column of another one and its type.
Shape = Callable[[Column, T.DataType], Column]

#: Names of the codes, in the order of their numbers.
ENUMS = {
    "status": ["Pending", "Analyzing", "Completed", "Failed"],
    "capture_source": ["Camera", "Upload"],
    "urgency_level": ["Low", "Medium", "High", "Critical"],
    "decision_outcome": ["AutoApprove", "HumanReview", "Escalate"],
    "fraud_risk_level": ["Low", "Medium", "High", "Critical"],
    "severity": ["Minor", "Moderate", "Severe", "Critical"],
    "safety_rating": ["Safe", "Warning", "Critical"],
    "repair_category": ["Replace", "Repair", "Polish"],
}
#: What is copied of an inspection, a damage, a file's result, a picture and an override.
INSPECTION = [
    "id", "image_url", "original_file_name", "thumbnail_url", "created_at", "completed_at", "user_provided_make", "user_provided_model", "user_provided_year", "mileage", "capture_latitude", "capture_longitude",
    "capture_gps_accuracy", "capture_device_info", "vehicle_make", "vehicle_model", "vehicle_year", "vehicle_color", "summary", "total_estimated_cost_min", "total_estimated_cost_max", "currency", "is_driveable",
    "structural_integrity", "error_message", "labor_total", "parts_total", "materials_total", "gross_total", "decision_reason", "agent_confidence", "agent_stp_eligible", "agent_fallback_used", "agent_processing_time_ms",
    "agent_weather_assessment", "fraud_risk_score", "analysis_mode", "evidence_hash", "forensic_result_hash", "agent_decision_hash", "timestamp_authority",
]
DAMAGE = ["id", "damage_type", "car_part", "description", "confidence", "repair_method", "estimated_cost_min", "estimated_cost_max", "labor_hours", "parts_needed", "bounding_box", "damage_cause", "material_type", "repair_operations"]
RESULT = [
    "file_name", "file_url", "sort_order", "overall_risk_score", "overall_risk_score100", "overall_risk_level", "ela_heatmap_url", "fft_spectrum_url", "spectral_heatmap_url", "total_processing_time_ms", "predicted_source", "source_confidence",
    "c2pa_status", "c2pa_issuer",
]
IMAGE = ["id", "image_url", "original_file_name", "sort_order"]
OVERRIDE = ["original_outcome", "new_outcome", "reason", "operator_name", "created_at"]
#: JSON columns, the field that they become, its type, and whether broken ones are an empty list instead of null.
INSPECTION_JSON = {
    "decision_trace_json": ("decision_traces", "array<struct<ruleName:string,ruleDescription:string,triggered:boolean,evaluatedValue:string,threshold:string>>", True),
    "agent_decision_json": ("agent_decision", "struct<outcome:string,confidence:double,reasoning:string,summary:string>", False),
    "cross_image_findings_json": ("cross_image_report", "struct<groupRiskScore:double,findings:array<struct<code:string,riskScore:double>>>", False),
    "image_hashes_json": ("image_hashes", "array<struct<fileName:string,sha256:string>>", False),
    "chain_of_custody_json": ("chain_of_custody", "array<struct<event:string,timestamp:string,hash:string,details:string>>", False),
}
RESULT_JSON = {
    "module_results_json": ("modules", "array<struct<moduleName:string,riskScore:double,riskLevel:string,error:string,findings:array<struct<code:string,riskScore:double,confidence:double>>>>", True),
    "verdict_probabilities_json": ("verdict_probabilities", "map<string,double>", False),
    "page_preview_urls_json": ("page_preview_urls", "array<string>", False),
}
DAMAGE_JSON = {"repair_line_items_json": ("repair_line_items", "array<struct<lineNumber:int,partName:string,operation:string,laborHours:double,quantity:int,totalCost:double>>", True)}


def name_of(code: Column, names: list[str]) -> Column:
    """A code's name; an unknown number stands for itself, null for null."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), F.when(code >= 0, code + 1).cast("int")), code.cast("string"))


def parsed(text: Column, kind: str, empty: bool) -> Column:
    """A JSON text as its type. A broken one, and one of another kind, are null, or an empty list.

    The first characters are looked at before it is parsed: a parser that gives up makes an exception, which takes longer than many good texts.
    """
    opens = r"^ *\[" if kind.startswith("array") else r"""^ *\{[ \t\r\n]*["'}]"""
    valid = F.when(text.rlike(opens) & F.try_parse_json(text).isNotNull(), F.from_json(text, kind))
    return F.coalesce(valid, F.array().cast(kind)) if empty else valid


#: Of children by the list that they become: what is copied, their codes and JSON, and their order.
CHILDREN = {
    "damages": (DAMAGE, ["severity", "safety_rating", "repair_category"], DAMAGE_JSON, ["id"]),
    "additional_images": (IMAGE, [], {}, ["sort_order", "id"]),
    "decision_overrides": (OVERRIDE, [], {}, ["id"]),
    "file_forensic_results": (RESULT, [], RESULT_JSON, ["sort_order", "file_name"]),
}
#: Children's rows that a task groups, on average: as text they are some 60 MB, which are sorted in memory.
ROWS = 100_000


def _fields(columns: list[str], enums: list[str], json: dict, col: Callable[[str], Column] = F.col) -> list[Column]:
    """The fields of a table's DTO in the order: copied ones, names of codes, parsed JSON. col makes a column of its name."""
    return [*(col(c).alias(c) for c in columns), *(name_of(col(e), ENUMS[e]).alias(e) for e in enums), *(parsed(col(c), kind, empty).alias(name) for c, (name, kind, empty) in json.items())]


def _child(df: DataFrame, name: str, order: list[str], fields: list[Column], shape: Shape) -> DataFrame:
    """The inspection_id of each child, and in a column of this name its key of order, which isn't part of it, and what is made of it."""
    rows = df.select("inspection_id", F.struct(*order).alias("o"), *fields)
    return rows.select("inspection_id", F.struct("o", shape(F.struct(*rows.columns[2:]), T.StructType(rows.schema.fields[2:])).alias("x")).alias(name))


def _in_order(children: str, kind: T.DataType) -> Column:
    """What was made of the children, in their order. Ties go by their text: maps have no order, their JSON has."""
    text = (lambda c: F.to_json(c["x"])) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else lambda c: c["x"]
    before = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(text(a) < text(b), -1).when(text(a) > text(b), 1).otherwise(0)
    return F.transform(F.array_sort(children, before), lambda c: c["x"]).alias(children)


def _lists(rows: DataFrame, made: dict[str, T.DataType]) -> DataFrame:
    """A row per inspection_id of rows that are dealt out by it, as id: its children of each kind as an array in their order."""
    lists = rows.groupBy(F.col("inspection_id").alias("id")).agg(*(F.collect_list(n).alias(n) for n in made))
    return lists.select("id", *(_in_order(n, kind) for n, kind in made.items()))


def _gathered(kinds: list[DataFrame]) -> DataFrame:
    """An inspection's children of all kinds in one row under its id, each kind as an array in its order: one shuffle and one grouping for all of them.

    Rows are moved before they are grouped, since an inspection has too few children of a kind for lists of them to be moved instead.
    """
    made = {k.columns[1]: k.schema[1].dataType["x"].dataType for k in kinds}
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    return _lists(rows.repartition("inspection_id"), made)


def _owned(inspections: DataFrame, users: DataFrame) -> DataFrame:
    """inspections with owner_email and owner_full_name. Those without a user are dealt out by their ids; as one key they would be one task's."""
    key = F.coalesce(F.col("user_id").cast("string"), F.xxhash64("id").cast("string"))
    owners = users.select(F.col("id").cast("string").alias("_owner"), F.col("email").alias("owner_email"), F.col("full_name").alias("owner_full_name"))
    return inspections.withColumn("_key", key).join(owners, (F.col("_key") == F.col("_owner")) & F.col("user_id").isNotNull(), "left").drop("user_id", "_key", "_owner")


def _own_fields(col: Callable[[str], Column] = F.col) -> list[Column]:
    return [
        *_fields(INSPECTION, ["status", "capture_source", "urgency_level", "decision_outcome", "fraud_risk_level"], INSPECTION_JSON, col),
        col("timestamp_token").isNotNull().alias("has_timestamp"), F.date_format(col("timestamped_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamped_at"),
    ]


def _with_lists(own: DataFrame, lists: DataFrame) -> DataFrame:
    empty = {name: F.coalesce(name, F.array().cast(lists.schema[name].dataType)) for name in lists.columns[1:]}
    return own.join(lists, "id", "left").withColumns(empty).withColumn("forensic_result", F.try_element_at("file_forensic_results", F.lit(1)))


def inspection_dto(
    inspections: DataFrame, users: DataFrame, results: DataFrame, images: DataFrame, damages: DataFrame, overrides: DataFrame, shape: Shape = lambda column, kind: column
) -> DataFrame:
    """A row per inspection. Owner fields are null without a user, lists of children are empty without any, forensic_result is the first file's.

    Damages and overrides are in the order of their ids, pictures and results in that of sort_order; ties go by the fields. shape makes of each child,
    and of an inspection's parsed JSON, what is returned of it; it is applied to single rows, before they are moved.
    """
    own = inspections.select(*_own_fields(), "user_id")
    nested = {name: shape(F.col(name), own.schema[name].dataType) for name, _, _ in INSPECTION_JSON.values()}
    frames = {"damages": damages, "additional_images": images, "decision_overrides": overrides, "file_forensic_results": results}
    lists = _gathered([_child(frames[name], name, order, _fields(*what), shape) for name, (*what, order) in CHILDREN.items()])
    return _with_lists(_owned(own.withColumns(nested), users), lists)


def inspection_dto_of_rows(
    orders: DataFrame, inspection: list[str], users: DataFrame, lines: DataFrame, children: dict[str, tuple[list[str], str]], shape: Shape = lambda column, kind: column
) -> DataFrame:
    """inspection_dto of entities that are made of shorter rows by expressions: the rows are moved, and columns and texts are made where they arrive.

    Inspections are made of orders, which have their id and user_id besides what the expressions need; children of lines, which have inspection_id,
    each kind by its expressions and condition. Joins and sorts are of rows; texts of children are grouped in as many tasks as let
    them stay in memory (ROWS), and an inspection's own are made last.
    """
    n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() / ROWS))
    moved = lines.repartition(n, "inspection_id")
    rows, made = ["inspection_id"], {}
    for name, (*what, order) in CHILDREN.items():
        columns, condition = children[name]
        of = _by_name(columns)
        fields = F.struct(*_fields(*what, of))
        x = shape(fields, moved.select(fields.alias(name)).schema[name].dataType)
        rows.append(F.when(F.expr(condition), F.struct(F.struct(*(of(c).alias(c) for c in order)).alias("o"), x.alias("x"))).alias(name))
        made[name] = moved.select(x.alias(name)).schema[name].dataType
    lists = _lists(moved.select(*rows), made).hint("merge")  # they are far larger than the rows by which their size would be guessed
    out = _with_lists(_owned(orders, users), lists)
    own = out.select(*_own_fields(_by_name(inspection)), *(c for c in out.columns if c not in orders.columns))
    return own.withColumns({name: shape(F.col(name), own.schema[name].dataType) for name, _, _ in INSPECTION_JSON.values()})


def _by_name(columns: list[str]) -> Callable[[str], Column]:
    """The columns of a select list, each "expression AS name", by their names. They are written into what is made of them, so that one projection makes a text of a row."""
    made = {name: sql for sql, name in (c.rsplit(" AS ", 1) for c in columns)}
    return lambda name: F.expr(made[name])
