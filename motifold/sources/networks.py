"""Graphs from raw networks: offshore companies (CSV), mail (message files), incidents (one wide table).

Each function takes frames as Spark reads them and returns node and edge records; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.sources.records import edge_records, node_records, write_json


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet on the driver's disk; needs pandas with a spreadsheet engine. Empty cells are null."""
    import pandas as pd

    table = pd.read_excel(path, dtype=object)
    return spark.createDataFrame(table.where(table.notna(), None).astype("string"))


def row_count(df: DataFrame) -> int:
    return df.count()


# values


def parse_date(column: Column) -> Column:
    """A day such as 23-MAR-2006 as an ISO string, or null."""
    return F.date_format(F.try_to_timestamp(F.initcap(F.trim(column)), F.lit("d-MMM-yyyy")), "yyyy-MM-dd")


def earliest(*columns: Column) -> Column:
    """The first of the dates that can be read."""
    dates = [parse_date(c) for c in columns]
    return F.least(*dates) if len(dates) > 1 else dates[0]


def split_values(column: Column) -> Column:
    """Values between semicolons, trimmed, without empty ones; nothing gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def _one(df: DataFrame, key: str) -> DataFrame:
    """A row for each key: the least of its records."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_least")).select(key, "_least.*")


def _text(df: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) if name in df.columns else F.lit("")


# offshore companies

#: Fixed columns of each node type: property and the CSV column it comes from.
OFFSHORE = {
    "Entity": {"name": "name", "original_name": "original_name", "former_name": "former_name", "jurisdiction": "jurisdiction", "jurisdiction_desc": "jurisdiction_description", "company_type": "company_type", "address": "address", "internal_id": "internal_id", "service_provider": "service_provider", "ibcRUC": "ibcRUC", "country_codes": "country_codes", "countries": "countries", "note": "note", "source_id": "sourceID"},
    "Officer": {"name": "name", "icij_id": "icij_id", "country_codes": "country_codes", "countries": "countries", "note": "note", "source_id": "sourceID"},
    "Intermediary": {"name": "name", "internal_id": "internal_id", "address": "address", "country_codes": "country_codes", "countries": "countries", "status": "status", "note": "note", "source_id": "sourceID"},
    "Address": {"address": "address", "icij_id": "icij_id", "country_codes": "country_codes", "countries": "countries", "note": "note", "source_id": "sourceID"},
}


def offshore_nodes(rows: DataFrame, label: str) -> DataFrame:
    """Static node records of one type, each node once."""
    columns = OFFSHORE[label]
    lists = ("country_codes", "countries")
    parts = [(split_values(F.col(c) if c in rows.columns else F.lit(None).cast("string")) if p in lists else _text(rows, c)).alias(p) for p, c in columns.items()]
    wide = rows.where(F.col("node_id").isNotNull()).select(F.col("node_id").cast("long").alias("_id"), *parts)
    wide = _one(wide, "_id")
    return node_records(wide, "_id", label, list(columns))


def offshore_entity_status(rows: DataFrame) -> DataFrame:
    """Dynamic records of entities: the status, valid from incorporation to the earliest of three ends; only with a status and a bound."""
    start = parse_date(_text(rows, "incorporation_date"))
    end = earliest(*[_text(rows, c) for c in ("inactivation_date", "struck_off_date", "dorm_date")])
    wide = rows.select(F.col("node_id").cast("long").alias("node_id"), _text(rows, "status").alias("status"), start.alias("from"), end.alias("to"))
    kept = wide.where("status <> '' and (`from` is not null or `to` is not null)")
    return kept.select("node_id", F.array(F.lit("Entity")).alias("labels"), F.lit(True).alias("is_active"), "from", "to", F.struct("status").alias("dynamic_props"))


def offshore_edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Static records, each edge once by a hash of all that it holds, without self-loops; and dynamic ones for those with a bound."""
    ends = rows.select(F.col("node_1").cast("long").alias("source_id"), F.col("node_2").cast("long").alias("target_id"), _text(rows, "rel_type").alias("edge_type"), parse_date(_text(rows, "start_date")).alias("from"), parse_date(_text(rows, "end_date")).alias("to"))
    kept = ends.where("source_id is not null and target_id is not null and source_id <> target_id")
    keyed = kept.withColumn("edge_id", F.sha2(F.to_json(F.struct("source_id", "target_id", "edge_type", "from", "to"), {"ignoreNullFields": "false"}), 256)).dropDuplicates(["edge_id"])
    static = keyed.select("edge_id", "source_id", "target_id", "edge_type")
    dynamic = keyed.where("`from` is not null or `to` is not null").select("edge_id", "source_id", "target_id", "edge_type", "from", "to", F.struct(F.lit(True).alias("active")).alias("dynamic_props"))
    return static, dynamic


# mail


def read_mail(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value) of the message files below a folder: those whose names end in a dot or a digit."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    return files.where(F.col("path").rlike(r"[.\d]$"))


def _header(name: str) -> Column:
    """A header's value with its continuation lines, or null."""
    head = F.regexp_replace(F.regexp_replace(F.element_at(F.split("value", r"\r?\n\r?\n", 2), 1), r"\r\n", "\n"), r"\n[ \t]+", " ")
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*)$", 1)
    return F.when(F.regexp_like(head, F.lit(rf"(?im)^{name}:")), found)


def parse_mail(messages: DataFrame) -> DataFrame:
    """(sender, recipients, cc, bcc, timestamp) of messages that have a sender, recipients and a date that can be read."""
    people = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    date = F.regexp_extract(_header("Date"), r"(\d{1,2} \w{3} \d{4} \d{1,2}:\d{2}:\d{2} [+-]\d{4})", 1)
    moment = F.try_to_timestamp(date, F.lit("d MMM yyyy H:mm:ss Z"))
    zone = F.regexp_extract(date, r"([+-]\d{2})(\d{2})$", 1)
    minutes = F.regexp_extract(date, r"([+-]\d{2})(\d{2})$", 2)
    local = F.regexp_extract(date, r"^(.*) [+-]\d{4}$", 1)
    iso = F.concat(F.date_format(F.try_to_timestamp(local, F.lit("d MMM yyyy H:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss"), zone, F.lit(":"), minutes)
    rows = messages.select(F.lower(F.trim(_header("From"))).alias("sender"), people(_header("To")).alias("recipients"), people(_header("X-cc")).alias("cc"), people(_header("X-bcc")).alias("bcc"), F.when(moment.isNotNull(), iso).alias("timestamp"))
    return rows.where("sender <> '' and size(recipients) > 0 and timestamp is not null")


def mail_graph(mails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People by address, and TO, CC and BCC edges with the message's time; each edge once."""
    types = {"TO": "recipients", "CC": "cc", "BCC": "bcc"}

    def typed(kind: str, people: str) -> Column:
        return F.transform(people, lambda x: F.struct(F.lit(kind).alias("edge_type"), x.alias("target_id")))

    each = F.concat(*[typed(t, c) for t, c in types.items()])
    edges = mails.select(F.col("sender").alias("source_id"), "timestamp", F.explode(each).alias("e")).select("source_id", "e.*", "timestamp")
    people = edges.select(F.explode(F.array("source_id", "target_id")).alias("email")).distinct()
    keyed = edges.where("source_id <> target_id").withColumn("edge_id", F.sha2(F.to_json(F.struct("source_id", "target_id", "edge_type", "timestamp")), 256)).dropDuplicates(["edge_id"])
    return node_records(people, "email", "Person", ["email"]), edge_records(keyed, ["timestamp"])


# incidents

#: Fixed groups of columns: label, edge type, for each repetition the columns by property, and the key column where there is one.
_DETAIL = ("nperps", "nperpcap", "nkill", "nkillus", "nkillter", "nwound", "nwoundus", "nwoundte", "ishostkid", "nhostkid", "nhostkidus", "nhours", "ndays", "divert", "kidhijcountry", "nreleased")
_INCIDENT = ("iyear", "imonth", "iday", "approxdate", "resolution", "extended", "summary", "doubtterr", "multiple", "success", "suicide", "individual", "compclaim", "weapdetail", "dbsource", "addnotes")


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


INCIDENT_PARTS: list[tuple[str, str, list[dict[str, str]], str | None]] = [
    ("Detail", "IS_CHARACTERIZED_BY", [_same(*_DETAIL)], None),
    ("Source", "IS_POWERED_BY", [{"scite": f"scite{i}"} for i in (1, 2, 3)], None),
    ("Criteria", "IS_BASED_ON", [{"crit": f"crit{i}"} for i in (1, 2, 3)], None),
    ("Motive", "IS_CAUSED_BY", [_same("motive")], None),
    ("Country", "OCCURRED_IN", [{"country": "country_txt"}], "country"),
    ("Region", "OCCURRED_IN", [{"region": "region_txt"}], "region"),
    ("Province", "OCCURRED_IN", [_same("provstate")], None),
    ("City", "OCCURRED_IN", [_same("city", "latitude", "longitude", "specificity", "vicinity", "location")], None),
    ("Property", "HAS_PROPERTY", [{"property": "property", "propextentid": "propextent", "propextent": "propextent_txt", "propvalue": "propvalue", "propcomment": "propcomment"}], None),
    ("Weapon", "EMPLOYED", [{"weaptypeid": f"weaptype{i}", "weaptype": f"weaptype{i}_txt", "weapsubtypeid": f"weapsubtype{i}", "weapsubtype": f"weapsubtype{i}_txt"} for i in (1, 2, 3, 4)], None),
    ("Claim", "HAS_CLAIM", [{"claim": f"claim{c}", "claimmodeid": f"claimmode{m}", "claimmode": f"claimmode{m}_txt"} for c, m in (("ed", ""), ("2", "2"), ("3", "3"))], None),
    ("GroupName", "IS_CARRIED_OUT_BY", [{"gname": f"gname{g}", "gsubname": f"gsubname{g}", "guncertain": f"guncertain{i}"} for g, i in (("", 1), ("2", 2), ("3", 3))], None),
    ("Ransom", "DEMANDS", [_same("ransom", "ransomamt", "ransomamtus", "ransompaid", "ransompaidus", "ransomnote")], None),
    ("HostageOutcome", "HAS", [{"hostkidoutcome": "hostkidoutcome_text"}], "hostkidoutcome"),
    ("Target", "IS_MEANT_TO", [{"corp": f"corp{i}", "target": f"target{i}", "targtype_id": f"targtype{i}", "targtype": f"targtype{i}_txt", "targsubtype_id": f"targsubtype{i}", "targsubtype": f"targsubtype{i}_txt"} for i in (1, 2, 3)], None),
]


def incident_graph(rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Node records by label (16 of them), and the edges between them (14 types), from one wide table with a row for each incident.

    Nodes without a key of their own have the hash of what they hold; parts that hold nothing give no node. A target's
    nationality leads to the incident's country, the only one that the table gives.
    """
    col = lambda name: (F.col(f"`{name}`") if name in rows.columns else F.lit(None)).cast("string")
    base = rows.where(F.col("eventid").isNotNull())
    parts, nodes = [], {}
    country = F.when(col("country").isNotNull(), F.concat(F.lit("Country:"), col("country")))
    for label, edge, repeats, key in INCIDENT_PARTS:
        for columns in repeats:
            held = F.struct(*[col(c).alias(p) for p, c in columns.items()])
            some = reduce(lambda a, b: a | b, [col(c).isNotNull() for c in columns.values()])
            name = F.when(col(key).isNotNull(), F.concat(F.lit(f"{label}:"), col(key))) if key else F.when(some, F.sha2(F.concat(F.lit(label), F.to_json(held)), 256))
            parts.append((label, edge, name, held))
    for label, _, repeats, _ in INCIDENT_PARTS:
        pairs = F.array(*[F.struct(n.alias("node_id"), h.alias("p")) for x, _, n, h in parts if x == label])
        own = _one(base.select(F.explode(pairs).alias("e")).where("e.node_id is not null").select("e.node_id", "e.p.*"), "node_id")
        nodes[label] = node_records(own, "node_id", label, list(repeats[0]))
    nodes["Incident"] = node_records(_one(base.select(col("eventid").alias("node_id"), *[col(c).alias(c) for c in _INCIDENT], col("alternative_txt").alias("alternative")), "node_id"), "node_id", "Incident", [*_INCIDENT, "alternative"])
    link = lambda a, b, t: F.struct(a.alias("source_id"), b.alias("target_id"), F.lit(t).alias("edge_type"))
    links = [link(col("eventid"), n, t) for _, t, n, _ in parts] + [link(n, country, "HAS_NATIONALITY") for x, _, n, _ in parts if x == "Target"]
    related = F.transform(F.filter(F.split(F.coalesce(col("related"), F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: link(col("eventid"), F.trim(x), "IS_RELATED_TO"))
    edges = base.select(F.explode(F.concat(F.array(*links), related)).alias("e")).select("e.*").where("source_id is not null and target_id is not null")
    keyed = edges.distinct().withColumn("edge_id", F.sha2(F.to_json(F.struct("source_id", "target_id", "edge_type")), 256))
    return nodes, keyed.select("edge_id", "source_id", "target_id", "edge_type")


# loaders: from raw files to record files


def _write(folder: str, frames: dict[str, DataFrame | None]) -> None:
    for group, df in frames.items():
        if df is not None:
            write_json(df, folder, group)


def load_offshore(spark: SparkSession, nodes: dict[str, str], relations: str, folder: str) -> None:
    """Record files of the offshore network: nodes maps each label to its CSV file, relations is the CSV file of edges."""
    rows = {label: read_csv(spark, path) for label, path in nodes.items()}
    static, dynamic = offshore_edges(read_csv(spark, relations))
    _write(folder, {f"{label.lower()}_nodes_static_props": offshore_nodes(df, label) for label, df in rows.items()})
    _write(folder, {"entity_nodes_dynamic_props": offshore_entity_status(rows["Entity"]) if "Entity" in rows else None, "edges_static_props": static, "edges_dynamic_props": dynamic})


def load_mail(spark: SparkSession, mails: str, folder: str) -> None:
    """Record files of the mail network below a folder of message files."""
    people, edges = mail_graph(parse_mail(read_mail(spark, mails)))
    _write(folder, {"person_nodes_static_props": people, "edges_static_props": edges})


def load_incidents(spark: SparkSession, path: str, folder: str) -> None:
    """Record files of the incident network, from a CSV file or a spreadsheet."""
    nodes, edges = incident_graph(read_excel(spark, path) if path.endswith((".xlsx", ".xls")) else read_csv(spark, path))
    _write(folder, {f"{label.lower()}_nodes_static_props": df for label, df in nodes.items()} | {"edges_static_props": edges})
