"""A corpus of JavaScript-like texts derived from orders, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTS = [
    ("{k} % 3 = 0", 'fetch("/api/v', "{k} % 4 + 1", "/orders/", "{k} % 500", '");\n'),
    ("{k} % 5 = 0", "\n// login flow\nnavigate('/login/step", "{k} % 7", "');\nopen(\"/admin/", "{k} % 11", '");\n'),
    ("{k} % 7 = 0", 'const base = "https://svc', "{k} % 9", '.acme.io/path/', "{k} % 40", '";\nvar u = "//h', "{k} % 3", '.acme.io/api/items";\n'),
    ("{k} % 11 = 0", "host = 10.", "{k} % 256", ".1.7;\npeer = 192.168.0.", "{k} % 200", ';\nlet dev = "localhost:', "{k} % 9000 + 1000", '";\nconst n = "db', "{k} % 5", '.internal";\n'),
    ("{k} % 13 = 0", "// contact ops", "{k} % 50", "@acme.io or noreply@acme.io\n"),
    ("{k} % 17 = 0", 'k1 = "AKIA', "substr(upper(md5(cast({k} AS varchar(20)))), 1, 16)", '";\nconst password = "pw-', "{k} % 90", '-secretword";\nstripe("sk_live_', "substr(md5(cast({k} AS varchar(20))), 1, 28)", '");\n'),
    ("{k} % 19 = 0", "const a = process.env.API_TOKEN;\nconst b = process.env.DB_HOST || \"localhost\";\nconst c = process.env.NEXT_PUBLIC_KEY;\n"),
    ("{k} % 23 = 0", 'localStorage.setItem("key', "{k} % 6", '", v);\nsessionStorage.getItem("sess', "{k} % 4", '");\nindexedDB.open("db', "{k} % 3", '");\n'),
    ("{k} % 29 = 0", 'app.use(cors({ origin: true }));\nfetch(u, { credentials: "include" });\nhead("Access-Control-Allow-Origin: *");\n'),
    ("{k} % 31 = 0", "console.log(\"order ", "{k} % 1000", " was loaded\");\n// TODO: remove this before release ", "{k} % 8", "\ndebugger;\n"),
    ("{k} % 37 = 0", 'load("https://cdn.jsdelivr.net/npm/x', "{k} % 5", '.js");\nload("https://cdnjs.cloudflare.com/y', "{k} % 5", '.js");\nload("https://d', "{k} % 12", '.cloudfront.net/z.js");\n'),
    ("{k} % 41 = 0", 'import React from "react";\nuseState(0);\naxios.get("/users/', "{k} % 10", '/cart");\n$.post("/checkout/', "{k} % 6", '");\n'),
    ("{k} % 43 = 0", 'docs = "/static/swagger.json";\nui = "/x/api-docs/v', "{k} % 4", '";\nget("data/report', "{k} % 20", '.csv");\nget("a.json");\n//# sourceMappingURL=app', "{k} % 5", ".js.map\n"),
    ("{k} % 47 = 0", "query GetOrder", "{k} % 9", " { id }\nmutation SetOrder($id: Int) { ok }\n"),
    ("{k} % 53 = 0", 'arn = "arn:aws:iam::', "{k} % 1000 + 1000", ':role/deploy";\nput("s3://bucket-', "{k} % 30", '-data/x");\n'),
    ("{k} % 59 = 0", 'WebAssembly.instantiateStreaming(fetch("m', "{k} % 4", '.wasm"));\nnew webpack.DefinePlugin({ API_URL: JSON.stringify("https://w', "{k} % 4", '.acme.io"), MODE: "prod" });\n'),
    ("{k} % 61 = 0", 'const t = "eyJ', "md5(cast({k} AS varchar(20)))", ".eyJ", "md5(cast({k} + 1 AS varchar(20)))", '.c2ln";\nuser = "admin";\nsigning_secret = "s', "{k} % 100", '-longenough";\n'),
    ("{k} % 67 = 0", 'axios.get("items/', "{k} % 10", '");\nseed = "GHIJKLMNOPQRSTUVWXYZghijklmnopq', "{k} % 1000", '";\n'),
    ("{k} % 2 = 0", 'save("/settings/', "{k} % 20", '/");\nsave("/settings/', "{k} % 20", '");\n'),
]
_OBFUSCATED = [
    ("{k} % 6 = 0", 'go("\\x2fadmin\\x2f', "{k} % 12", '");\n'),
    ("{k} % 10 = 0", 'go("/lo" + \'gin/\' + "q', "{k} % 9", '");\n'),
    ("{k} % 14 = 0", 'go(atob("L2FkbWluL2FyZWE="));\n'),
    ("{k} % 15 = 0", "go(String.fromCharCode(47,97,117,116,104,47,120));\n"),
]


def _columns(key: str, obfuscated: bool, dialect: str) -> tuple[str, str]:
    """The expressions of source and text."""
    quote = lambda s: "'" + (s.replace("\\", "\\\\") if dialect == "spark" else s).replace("'", "\\'" if dialect == "spark" else "''") + "'"
    pieces = []
    for when, *rest in _PARTS + (_OBFUSCATED if obfuscated else []):
        said = [quote(x) if i % 2 == 0 else f"cast({x.format(k=key)} AS varchar(64))" for i, x in enumerate(rest)]
        pieces.append(f"CASE WHEN {when.format(k=key)} THEN concat({', '.join(said)}) ELSE '' END")
    head = f"concat('// file ', cast({key} AS varchar(20)), {quote(chr(10))})"
    return f"concat('app/m', cast({key} % 97 AS varchar(20)), '/f', cast({key} AS varchar(20)), '.js')", f"concat({head}, {', '.join(pieces)})"


def corpus_sql(key: str = "o_orderkey", table: str = "orders", obfuscated: bool = False, dialect: str = "spark") -> str:
    """(source, text) of each row of table; a source is unique to its key."""
    source, text = _columns(key, obfuscated, dialect)
    return f"SELECT {source} AS source, {text} AS text FROM {table}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it has fewer partitions than there are cores: for narrow rows of which much is derived."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Texts of a task: some megabytes, whatever the files and row groups of the table are.
ROWS_A_TASK = 50_000


def corpus(spark: SparkSession, sf_dir: str, obfuscated: bool = False) -> DataFrame:
    """The corpus of a folder of tables, dealt by source while it is keys alone, so that what is grouped by source need not move."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    source, text = (F.expr(x) for x in _columns("o_orderkey", obfuscated, "spark"))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(orders.count() / ROWS_A_TASK))
    return orders.select("o_orderkey", source.alias("source")).repartition(tasks, "source").select("source", text.alias("text"))
