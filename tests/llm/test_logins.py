"""Logins in URLs are live by a rule of their own."""

from pyspark.sql import functions as F

from docquery.llm import secrets


def test_url_passwords_are_blanked(docs_of):
    docs = docs_of([(1, "see https://u:pa55word@h/ now"), (2, "ftp://me:k9zz@host"), (3, "http://u:example1@h/"), (4, "http://h:80/a")])
    by = {r.doc_id: r for r in secrets.scan(docs, owner=F.col("source"), repo=F.col("lang")).collect()}
    assert by[1].spans == "login:9:23" and by[1].n_live == 1 and by[2].spans == "login:3:14"
    assert by[3].spans == by[4].spans == ""
    found = secrets.classify(secrets.find(docs, owner=F.col("source"), repo=F.col("lang")))
    clean = {r.doc_id: r.text for r in secrets.redact(docs, found).collect()}
    assert clean[1] == "see https[secret]h/ now" and clean[2] == "ftp[secret]host" and clean[3] == "http://u:example1@h/"
