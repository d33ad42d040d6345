"""Articles from XML, CSV and parquet."""

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom import schemas
from themeloom.operators.batches import AT_ONCE, in_pieces

# The element that holds one article, and the CSV separator.
ROW_TAG = "document"
CSV_SEPARATOR = ";"

# The column that holds a record or line which could not be read.
CORRUPT = "corrupt_record"


def _fields_of(record: str, names: list[str]) -> dict[str, str] | None:
    """Text of the named elements at any depth, None if the record is no XML.

    A field that occurs several times gives the texts one after another, also
    where one stands inside another; one that does not occur is null.
    """
    try:
        tree = ElementTree.fromstring(record)
    except ElementTree.ParseError:
        return None
    found: dict[str, str] = {}
    for element in tree.iter():
        name = element.tag.rpartition("}")[2]
        if name in names:
            found[name] = found.get(name, "") + "".join(element.itertext())
    return found


def xml_records(spark: SparkSession, path: str, row_tag: str = ROW_TAG) -> DataFrame:
    """``record``: the text of each article element.

    The file is cut at the end tags by the text source, which splits a large
    file over many tasks; the XML source reads each file in one.
    """
    start, end = f"<{row_tag}>", f"</{row_tag}>"
    pieces = spark.read.option("lineSep", end).text(path).where(F.col("value").contains(start))
    # From the first start tag on: one inside the text is part of it.
    inside = F.expr(f"substring(value, locate('{start}', value) + {len(start)})")
    return pieces.select(F.concat(F.lit(start), inside, F.lit(end)).alias("record"))


def read_xml(
    spark: SparkSession,
    path: str,
    row_tag: str = ROW_TAG,
    mode: str = "FAILFAST",
    schema: T.StructType = schemas.DECLARED_ARTICLE,
    counted: Observation | None = None,
) -> DataFrame:
    """One row per article element, with the text of each field of ``schema``.

    A record is parsed once, which gives all fields: elements of that name at
    any depth, without the markup inside them. A record that is no XML stops
    the job in mode ``FAILFAST``; ``DROPMALFORMED`` leaves it out, and
    ``PERMISSIVE`` gives null fields and the record itself in a further
    column, ``corrupt_record``. ``counted`` gets ``n_records`` and
    ``n_corrupt`` in the same pass, whatever the mode.
    """
    if mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
        raise ValueError(f"no such mode: {mode}")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A parsed record takes several times its bytes.
        for batch in in_pieces(batches, AT_ONCE // 4):
            records = batch.column(0).to_pylist()
            parsed = [_fields_of(record, names) for record in records]
            columns = [[own.get(name) if own else None for own in parsed] for name in names]
            columns.append([None if own is not None else r for own, r in zip(parsed, records)])
            arrays = [pa.array(column, pa.string()) for column in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, CORRUPT])

    texts = [T.StructField(name, T.StringType()) for name in [*names, CORRUPT]]
    table = xml_records(spark, path, row_tag).mapInArrow(run, T.StructType(texts))
    bad = F.col(CORRUPT).isNotNull()
    if counted is not None:
        table = table.observe(
            counted,
            F.count(F.lit(1)).alias("n_records"),
            F.count(F.when(bad, 1)).alias("n_corrupt"),
        )
    if mode == "PERMISSIVE":
        return table
    if mode == "DROPMALFORMED":
        return table.where(~bad).drop(CORRUPT)
    complaint = F.concat(F.lit("a record is no XML: "), F.substring(CORRUPT, 1, 200))
    checked = [
        F.when(bad, F.raise_error(complaint).cast("string")).otherwise(F.col(name)).alias(name)
        for name in names
    ]
    return table.select(*checked)


def read_csv(
    spark: SparkSession,
    path: str,
    separator: str = CSV_SEPARATOR,
    schema: T.StructType | None = None,
    mode: str = "FAILFAST",
) -> DataFrame:
    """CSV with a header. Without a schema every column is text; nothing is inferred.

    With one, the header must name its columns, and values must be of its
    types; a line that fails is treated by ``mode`` as Spark does, and in mode
    ``PERMISSIVE`` it is kept in ``corrupt_record``.
    """
    if schema is None:
        return spark.read.csv(path, header=True, sep=separator)
    options = {"header": True, "sep": separator, "enforceSchema": False, "mode": mode}
    if mode == "PERMISSIVE":
        options["columnNameOfCorruptRecord"] = CORRUPT
        if CORRUPT not in schema.names:
            schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
            # The header has no such column, so names cannot be checked against it.
            options["enforceSchema"] = True
    return spark.read.schema(schema).options(**options).csv(path)


def with_numbers(table: DataFrame, *columns: str) -> DataFrame:
    """The named text columns as 64-bit whole numbers; unreadable values are null."""
    return table.withColumns({c: F.trim(F.col(c)).try_cast("bigint") for c in columns})


def from_documents(documents: DataFrame) -> DataFrame:
    """Articles out of a ``documents`` table, which has no date or title.

    The first line serves as title, and the ids are spread over two years.
    """
    day = F.date_add(F.lit("2015-07-01").cast("date"), ((F.col("doc_id") * 37) % 731).cast("int"))
    return documents.select(
        F.col("doc_id").alias("docid"),
        F.col("source").alias("publication"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        "text",
        "n_chars",
        day.alias("date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
    )


def spread(table: DataFrame, key: str = "docid") -> DataFrame:
    """Use all cores on an input that is cut into too few pieces.

    An input with at least one piece per core, as any large one has, is
    returned as it is; only a small one pays for a shuffle. Give a table as
    it was read: to count the pieces of a shuffled one, Spark would run it.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def sample(table: DataFrame, fraction: float = 0.01, seed: int = 0) -> DataFrame:
    return table.sample(withReplacement=False, fraction=fraction, seed=seed)
