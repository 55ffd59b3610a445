"""What happens to a table when a column appears in the middle of the stream."""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types whose every value the type after them holds, from narrow to wide.
WIDENING = (
    ("tinyint", "smallint", "int", "bigint"),
    ("tinyint", "smallint", "int", "double"),
    ("float", "double"),
    ("date", "timestamp"),
)


def describe_columns(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row per column: position, name, type, whether `before` lacked it, rows and non-NULL rows."""
    old = set(df.columns if before is None else before.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(f.name).alias(f"n_{i}") for i, f in enumerate(df.schema)]
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(f.name not in old).alias("is_new"),
                F.col("rows"),
                F.col(f"n_{i}").alias("non_null"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    return counts.select(F.explode(per_column).alias("c")).select("c.*")


def data_files(df: DataFrame) -> DataFrame:
    """Data files behind a file-based DataFrame, with the rows each contributes."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("rows"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files and rows kept, added and removed between two listings from data_files."""
    sides = before.withColumn("side", F.lit("before")).unionByName(after.withColumn("side", F.lit("after")))
    old, new = F.bool_or(F.col("side") == "before"), F.bool_or(F.col("side") == "after")
    status = F.when(old & new, "kept").when(new, "added").otherwise("removed")
    per_file = sides.groupBy("file_path").agg(status.alias("status"), F.max("rows").alias("rows"))
    return per_file.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


def coverage_by_day(trips: DataFrame, column: str = "surge_multiplier") -> DataFrame:
    return (
        trips.groupBy(F.to_date("event_time").alias("event_day"))
        .agg(F.count(F.lit(1)).alias("trips"), F.count(column).alias("with_value"))
        .withColumn("without_value", F.col("trips") - F.col("with_value"))
    )


def first_and_last(df: DataFrame, key: str, first: int = 3, last: int = 2) -> DataFrame:
    """The ends of a long list, with how many rows lie between. Both ends are top-k, not sorts."""
    skipped = df.agg(F.greatest(F.count(F.lit(1)) - (first + last), F.lit(0))).scalar()
    head, tail = df.orderBy(F.asc(key)).limit(first), df.orderBy(F.desc(key)).limit(last)
    return (
        head.withColumn("end", F.lit("first"))
        .unionByName(tail.withColumn("end", F.lit("last")))
        .dropDuplicates([key])
        .withColumn("skipped", skipped)
    )


def _digits(kind: T.DataType) -> tuple[int, int] | None:
    """Digits before and after the point of an exact number type."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    whole = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}.get(kind.simpleString())
    return whole and (whole, 0)


def _widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of the old type is one of the new."""
    if isinstance(old, T.NullType):
        return True
    if isinstance(new, T.DecimalType) and _digits(old):
        return all(a <= b for a, b in zip(_digits(old), _digits(new)))
    names = old.simpleString(), new.simpleString()
    return any(set(names) <= set(line) and line.index(names[0]) < line.index(names[1]) for line in WIDENING)


def type_changes(old: T.DataType, new: T.DataType, path: str = "") -> Iterator[tuple[str, str, str | None, str | None]]:
    """(path, change, old type, new type) of every difference, down to nested fields, `[]` elements and `{}` values.

    A change is added, removed, widened (every old value fits the new type), retyped, or renamed_case where only
    the case of a name differs.
    """
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        prefix = f"{path}." if path else ""
        left = {f.name.lower(): f for f in old if f.name not in new.names}
        for field in new:
            if field.name in old.names:
                yield from type_changes(old[field.name].dataType, field.dataType, prefix + field.name)
            elif twin := left.pop(field.name.lower(), None):
                yield prefix + field.name, "renamed_case", twin.name, field.name
                yield from type_changes(twin.dataType, field.dataType, prefix + field.name)
            else:
                yield prefix + field.name, "added", None, field.dataType.simpleString()
        for field in left.values():
            yield prefix + field.name, "removed", field.dataType.simpleString(), None
    elif isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        yield from type_changes(old.elementType, new.elementType, f"{path}[]")
    elif isinstance(old, T.MapType) and isinstance(new, T.MapType):
        yield from type_changes(old.keyType, new.keyType, f"{path}{{key}}")
        yield from type_changes(old.valueType, new.valueType, f"{path}{{}}")
    elif old != new and old.simpleString() != new.simpleString():
        yield path, "widened" if _widens(old, new) else "retyped", old.simpleString(), new.simpleString()


def merged(old: T.DataType, new: T.DataType) -> T.DataType:
    """A type with all fields of both; where they differ in type, the wider one, and text where neither holds the other."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        fields = [T.StructField(f.name, merged(f.dataType, new[f.name].dataType) if f.name in new.names else f.dataType) for f in old]
        return T.StructType(fields + [f for f in new if f.name not in old.names])
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(merged(old.elementType, new.elementType))
    if old == new or _widens(old, new):
        return new
    if isinstance(new, T.NullType) or _widens(new, old):
        return old
    if _digits(old) and _digits(new):
        whole, scale = map(max, _digits(old), _digits(new))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    return T.StringType()


CHANGES = "path STRING, change STRING, old_type STRING, new_type STRING"


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per difference between the columns of two tables, nested ones included. Only schemas are looked at."""
    return after.sparkSession.createDataFrame(list(type_changes(before.schema, after.schema)), CHANGES)
