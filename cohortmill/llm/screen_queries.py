"""Queries of the operators that search texts for given phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from .decontaminate import find_contamination, hit_words
from .langid import fold
from .licenses import scan_licenses
from .registry import query, table
from .secret_forest import CREDENTIAL, scan_secrets

_LEAK_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.n, p.i, x.item_id FROM places p JOIN windows x USING (n, phrase)),
hit_words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(generate_series(0, n - 1)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


@query("op1_decontamination", _LEAK_SQL)
def op1_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), drop=("text",)).withColumn("n_hit", hit_words())
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op7_license_scan")
def op7_license_scan(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
                        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"))


#: Published forms of credentials, each from a letter's or digit's edge on.
PUBLISHED_FORMS = {
    "AWS access key id": r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "GitHub": r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{36,}",
    "GitLab": r"gl(?:pat|dt|rt|cbt|ptt|ft)-[A-Za-z0-9_\-]{20,}",
    "Slack": r"xox[abeoprs]-[A-Za-z0-9\-]{10,}",
    "Stripe": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9+/]{24,}",
    "Google": r"AIza[A-Za-z0-9_\-]{35}|GOCSPX-[A-Za-z0-9_\-]{28}",
    "npm": r"npm_[A-Za-z0-9]{36}",
    "PyPI": r"pypi-AgE[A-Za-z0-9_\-]{50,}",
    "Hugging Face": r"hf_[A-Za-z0-9]{34}",
    "OpenAI and alike": r"sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_\-]{20,}",
    "Shopify": r"shp(?:at|ca|pa|ss)_[0-9A-Fa-f]{32}",
    "DigitalOcean": r"do[por]_v1_[0-9a-f]{64}",
    "Twilio": r"SK[0-9a-f]{32}",
    "JSON web token": r"eyJ[A-Za-z0-9_\-]{13,}",
}
#: The known lengths of cloud keys in base64, without the filling: AWS secret keys and Azure account keys.
_BASE64_KEY = r"^(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9])(?:[A-Za-z0-9+/]{40}|[A-Za-z0-9+/]{86}(?:==)?)$"
#: What a password looks like: letters with digits and no address or placeholder.
_PASSWORD = r"^(?![$<%{])(?!\S*://)(?=[^A-Za-z]*[A-Za-z])(?=[^0-9]*[0-9])\S{6,}$"
_PLAIN_WORDS = r"^(?:[A-Z]?[a-z]++|[A-Z]++)(?:[/_+\-]++(?:[A-Z]?[a-z]++|[A-Z]++))*+$"


def true_finding():
    """What labels a finding: true, false, or null where no rule decides.

    True: a value with a published form, hexadecimal digits of either case or a base64 cloud key assigned to a
    credential's name, letters with digits assigned to a password's or secret's name, 4 to 8 digits to a pin's, and the
    lines beside the marks of a PEM private key. False: plain words and numbers that are not
    assigned to a credential's name. All else teaches nothing.
    """
    value, named = F.col("value"), F.col("key_word").rlike(CREDENTIAL)
    published = value.rlike("(?<![A-Za-z0-9])(?:" + "|".join(PUBLISHED_FORMS.values()) + ")")
    assigned = named & value.rlike(f"^[0-9A-Fa-f]{{16,}}$|{_BASE64_KEY}")
    typed = ((F.col("key_word").rlike("passw|pwd|passphrase|secret") & value.rlike(_PASSWORD))
             | (F.col("key_word").rlike("(?<![a-z])pin(?![a-z])") & value.rlike("^[0-9]{4,8}$")))
    pem = value.rlike("^[A-Za-z0-9+/]+$") & (F.col("before").rlike("^key-----$") | (F.col("after") == "-----end"))
    plain = value.rlike(f"{_PLAIN_WORDS}|^[0-9/_+\\-]+$")
    return F.when(published | assigned | typed | pem, True).when(plain & ~named, False)


@query("op3_secret_findings")
def op3_secret_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan_secrets(docs, true_finding(), fold("key") != 0)
    return found.where("score >= 0.5").select(F.col("key").alias("doc_id"), "word_no", F.sha2("value", 256).alias("value_sha256"),
                                              F.col("key_word").alias("name"), F.round("score", 6).alias("score"))
