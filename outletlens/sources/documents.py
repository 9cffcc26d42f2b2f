"""The nested graph document ``source1 -> source2 -> events`` as one JSON text.

An edge holds as many events as the two outlets share, which grows with the data, so no edge is
gathered into one value. The document is written as lines: the event rows are range-partitioned by
(source1, source2, eventId) and sorted inside the partitions, every row becomes the text of its
event, and the first and last event of an edge, an outlet or the document also carry the
braces around them. Which rows those are is known from the edges' aggregates (fewer than n^2 rows),
so writing needs one shuffle and a row's memory, however many events an edge has. The
part files, in name order, are the document::

    {"edgesData":{
     "a.com":{
      "b.com":{"eventsSharedCount":2,"meanToneDist":0.5,"events":{
       "17":{"avgTone1":1.0,"avgTone2":1.5,"url1":"...","url2":"..."},
       "18":{...}
      }},
      ...
     }
    },"nodes":{
     "a.com":{"mentionnedEventsCount":3,"avgTone":0.1},
     ...
    },"other":{"maxToneDist":0.5,"maxSharedEventsCount":2}}

Nodes come in the order of their event counts. Reading back goes line by line: an event line's
outlets are the last ones named above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outletlens.sources.files import presentation_order

EDGE, OUTLET, EVENT = "  ", " ", "   "  # indentation tells the lines apart

EDGE_FIELDS = "eventsSharedCount:long,meanToneDist:double"
EVENT_FIELDS = "avgTone1:double,avgTone2:double,url1:string,url2:string"
NODE_FIELDS = "mentionnedEventsCount:long,avgTone:double"
OTHER_FIELDS = "maxToneDist double, maxSharedEventsCount long"


def _object(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _name(name: Column) -> Column:
    """A JSON string."""
    body = F.to_json(F.struct(name.alias("k")))  # {"k":"..."}
    return F.substring(body, F.lit(6), F.length(body) - 6)


def edge_lines(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(source1, source2, eventId, value): the text of each event, with what opens and
    closes around it."""
    ends = events.groupBy("source1", "source2").agg(F.min("eventId").alias("_first"), F.max("eventId").alias("_last"))
    # one row per edge, of which there are fewer than n^2
    outlet, whole = Window.partitionBy("source1"), Window.partitionBy()
    marks = edges.join(ends, ["source1", "source2"]).select(
        "source1", "source2", "_first", "_last", "eventsSharedCount", "meanToneDist",
        (F.col("source2") == F.min("source2").over(outlet)).alias("_opens"),
        (F.col("source2") == F.max("source2").over(outlet)).alias("_closes"),
        (F.col("source1") == F.max("source1").over(whole)).alias("_ends"))
    first, last = F.col("eventId") == F.col("_first"), F.col("eventId") == F.col("_last")
    edge_head = F.concat(F.lit(EDGE), _name(F.col("source2")), F.lit(":"), F.regexp_replace(_object("eventsSharedCount", "meanToneDist"), "\\}$", ""),
                         F.lit(',"events":{\n'))
    head = F.when(first, F.concat(F.when(F.col("_opens"), F.concat(F.lit(OUTLET), _name(F.col("source1")), F.lit(":{\n"))).otherwise(""),
                                  edge_head)).otherwise("")
    tail = F.when(~last, ",").otherwise(F.concat(
        F.lit(f"\n{EDGE}}}}}"), F.when(~F.col("_closes"), ",").otherwise(
            F.concat(F.lit(f"\n{OUTLET}}}"), F.when(F.col("_ends"), "").otherwise(",")))))
    body = F.concat(F.lit(f'{EVENT}"'), F.col("eventId").cast("string"), F.lit('":'), _object("avgTone1", "avgTone2", "url1", "url2"))
    return events.join(marks, ["source1", "source2"]).select("source1", "source2", "eventId", F.concat(head, body, tail).alias("value"))


def write_graph_document(parts: dict[str, DataFrame], path: str) -> None:
    """The graph task's ``edges``, ``edge_events``, ``nodes`` and ``totals`` (one dataset) as one document below
    ``path``, whose files are to be read in name order. An edge's events are distinct."""
    spark = parts["edges"].sparkSession
    order = presentation_order("nodes", parts["nodes"])
    nodes = parts["nodes"].withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # at most n rows
    nodes = nodes.withColumn("_of", F.max("_n").over(Window.partitionBy()))
    lines = [
        (0, spark.range(1).select(F.lit('{"edgesData":{').alias("value"))),
        (1, edge_lines(parts["edges"], parts["edge_events"])),
        (2, spark.range(1).select(F.lit('},"nodes":{').alias("value"))),
        (3, nodes.select(F.col("_n").alias("eventId"), F.concat(
            F.lit(OUTLET), _name(F.col("mentionSourceName")), F.lit(":"), _object("mentionnedEventsCount", "avgTone"),
            F.when(F.col("_n") < F.col("_of"), ",").otherwise("")).alias("value"))),
        (4, parts["totals"].select(F.concat(F.lit('},"other":'), _object("maxToneDist", "maxSharedEventsCount"), F.lit("}")).alias("value"))),
    ]
    by = ["_section", "source1", "source2", "eventId"]
    out = None
    for section, df in lines:
        one = df.withColumn("_section", F.lit(section))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    out.repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.mode("overwrite").text(path)


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a document with what stands above them: (value, source1, source2, section). The last line of
    each kind is carried down inside a piece of a file, and from piece to piece by one row each."""
    lines = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start")).alias("_piece"),
        F.monotonically_increasing_id().alias("_line"))
    outlet = F.when(F.col("value").rlike(r'^ "'), F.col("value"))
    edge = F.when(F.col("value").rlike(r'^  "'), F.col("value"))
    section = F.when(F.col("value").rlike(r'^(\{"edgesData"|\},"nodes"|\},"other")'), F.regexp_extract("value", '^[{},]*"(\\w+)"', 1))
    lines = lines.withColumns({"_outlet": outlet, "_edge": edge, "_section": section})
    marks = ("_outlet", "_edge", "_section")
    inside = Window.partitionBy("_piece").orderBy("_line")
    above = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    carried = (lines.groupBy("_piece").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_line"))).alias(c) for c in marks))
               .select(F.col("_piece").alias("_at"), *(F.last(c, True).over(above).alias(f"{c}_above") for c in marks)))
    return (lines.withColumns({c: F.last(c, True).over(inside) for c in marks})
            .join(carried, F.col("_piece") == F.col("_at"))
            .select("value", *(F.coalesce(c, f"{c}_above").alias(c) for c in marks)))


def read_graph_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``edges``, ``edge_events``, ``nodes`` and ``totals`` of a document."""
    lines = document_lines(spark, path)
    bare = F.regexp_replace("value", ",$", "")

    def entry(text: Column, fields: str) -> Column:
        """The only entry of a one-key object."""
        return F.element_at(F.map_entries(F.from_json(text, f"map<string,struct<{fields}>>")), 1)

    source1 = F.element_at(F.map_keys(F.from_json(F.concat(F.lit("{"), "_outlet", F.lit("}}")), "map<string, string>")), 1)
    head = entry(F.concat(F.lit("{"), "_edge", F.lit("}}}")), EDGE_FIELDS)
    event = entry(F.concat(F.lit("{"), bare, F.lit("}")), EVENT_FIELDS)
    in_edges = F.col("_section") == "edgesData"
    edges = (lines.where(in_edges & F.col("value").rlike('^  "'))
             .select(source1.alias("source1"), head["key"].alias("source2"), head["value"]["eventsSharedCount"].alias("eventsSharedCount"),
                     head["value"]["meanToneDist"].alias("meanToneDist")))
    events = (lines.where(in_edges & F.col("value").rlike('^   "'))
              .select(source1.alias("source1"), head["key"].alias("source2"), event.alias("e"))
              .select("source1", "source2", F.col("e.key").cast("long").alias("eventId"), "e.value.*"))
    node = entry(F.concat(F.lit("{"), bare, F.lit("}")), NODE_FIELDS)
    nodes = (lines.where((F.col("_section") == "nodes") & F.col("value").rlike('^ "')).select(node.alias("e"))
             .select(F.col("e.key").alias("mentionSourceName"), "e.value.*"))
    other = F.from_json(F.regexp_extract("value", r'"other":(\{.*\})\}$', 1), OTHER_FIELDS)
    totals = lines.where(F.col("value").startswith('},"other"')).select(other.alias("o")).select("o.*")
    return {"edges": edges, "edge_events": events, "nodes": nodes, "totals": totals}
