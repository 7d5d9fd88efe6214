"""SQL fragments the check queries share (DuckDB dialect)."""

from __future__ import annotations

from ..functions import fixed_values as fv

# White space in RE2 spelling; not interchangeable with the Java class in functions.text.
W = r"\p{Z}\s\x0b\x1c-\x1f\x{85}"


def rx(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


def strip(expr: str) -> str:
    return rx(expr, f"^[{W}]+|[{W}]+$")


def clean(expr: str) -> str:
    """The eight cleaning steps one after the other."""
    e = rx(f"lower({expr})", f"[^{W}]+@[^{W}]+")
    e = rx(e, f"http[^{W}]+|www[^{W}]+")
    e = rx(e, "<[^>]+>")
    e = rx(e, f"[{W}]+", " ")
    e = rx(e, rf"[^\p{{L}}\p{{N}}_{W}]", " ")
    e = rx(e, r"\p{Nd}+")
    e = rx(e, f"[{W}]+", " ")
    return f"coalesce({rx(e, '^ +| +$')}, '')"


STOP_LIST = ", ".join(f"'{w}'" for w in fv.STOP_WORDS)


def words(cleaned: str) -> str:
    return (f"list_filter(string_split({cleaned}, ' '), "
            f"lambda w: length(w) > 2 AND NOT list_contains([{STOP_LIST}], w))")


def grams(toks: str) -> str:
    return (f"list_concat({toks}, list_transform(range(1, len({toks})), "
            f"lambda i: {toks}[i] || ' ' || {toks}[i + 1]))")


def normalize_label(expr: str) -> str:
    e = strip(f"lower({expr})")
    return (f"CASE WHEN {e} IN ('spam', '1') THEN 'spam' "
            f"WHEN {e} IN ('ham', 'legitimate', '0') THEN 'legitimate' ELSE 'unknown' END")


def errors(expr: str, measured: str | None = None) -> str:
    """' | '-joined error messages of a message."""
    s = strip(expr)
    m = measured or expr
    return f"""concat_ws(' | ',
      CASE WHEN {expr} IS NULL THEN '{fv.ERR_NONE}' END,
      CASE WHEN {s} = '' THEN '{fv.ERR_EMPTY}' END,
      CASE WHEN {s} <> '' AND length({s}) < 10 THEN '{fv.ERR_SHORT}' END,
      CASE WHEN {s} <> '' AND length({m}) > 10000 THEN '{fv.ERR_LONG}' END)"""


# Training messages: labelled documents, toxic = 1 is spam.
LABELLED = "SELECT d.doc_id AS row_id, d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)"

TOKENS = f"""tok AS (SELECT *, {words(clean('text'))} AS toks FROM src)"""


def tfidf_ctes(source: str, *, min_df: int = 2, max_df: float = 0.95, max_features: int = 5000) -> str:
    """CTEs src .. weights over ``source`` (row_id, text, label)."""
    return f"""
    src AS MATERIALIZED ({source}),
    {TOKENS.replace('tok AS (', 'tok AS MATERIALIZED (', 1)},
    occ AS (SELECT row_id, label, unnest({grams('toks')}) AS term FROM tok),
    counts AS MATERIALIZED (SELECT row_id, label, term, count(*) AS tf FROM occ GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM src),
    freq AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts GROUP BY term),
    vocab AS MATERIALIZED (
      SELECT term, df, cf, ln((1 + n)::DOUBLE / (1 + df)) + 1.0::DOUBLE AS idf,
             row_number() OVER (ORDER BY term) - 1 AS term_idx
      FROM (SELECT freq.*, n.n FROM freq, n
            WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * n ORDER BY cf DESC, term LIMIT {max_features})),
    raw AS (SELECT row_id, label, term, term_idx, tf, (1.0::DOUBLE + ln(tf)) * idf AS u FROM counts JOIN vocab USING (term)),
    weights AS MATERIALIZED (
      SELECT *, u / sqrt(sum(u * u) OVER (PARTITION BY row_id)) AS weight FROM raw)"""


NB_CTES = """
    s AS (SELECT v.term, v.term_idx, v.idf,
                 coalesce(sum(weight) FILTER (label = 0), 0.0::DOUBLE) AS s0,
                 coalesce(sum(weight) FILTER (label = 1), 0.0::DOUBLE) AS s1
          FROM vocab v LEFT JOIN weights w USING (term) GROUP BY ALL),
    tot AS (SELECT sum(s0) AS t0, sum(s1) AS t1, count(*) AS v FROM s),
    theta AS MATERIALIZED (SELECT term, term_idx, idf, ln((s0 + 1.0::DOUBLE) / (t0 + v)) AS theta0,
                     ln((s1 + 1.0::DOUBLE) / (t1 + v)) AS theta1 FROM s, tot),
    prior AS (SELECT ln(count(*) FILTER (label = 0)::DOUBLE / count(*)) AS prior0,
                     ln(count(*) FILTER (label = 1)::DOUBLE / count(*)) AS prior1 FROM src)"""


def nb_score_ctes(target: str) -> str:
    """CTEs scoring ``target`` (row_id, text) with theta and prior."""
    return f"""
    tgt AS MATERIALIZED ({target}),
    ttok AS MATERIALIZED (SELECT *, {words(clean('text'))} AS toks FROM tgt),
    tcnt AS (SELECT row_id, term, count(*) AS tf
             FROM (SELECT row_id, unnest({grams('toks')}) AS term FROM ttok) GROUP BY ALL),
    tsum AS (SELECT row_id, sum(u * theta0) AS d0, sum(u * theta1) AS d1, sqrt(sum(u * u)) AS nrm
             FROM (SELECT row_id, theta0, theta1, (1.0::DOUBLE + ln(tf)) * idf AS u
                   FROM tcnt JOIN theta USING (term)) GROUP BY row_id),
    lik AS (SELECT t.row_id, prior0 + coalesce(d0 / nrm, 0) AS l0, prior1 + coalesce(d1 / nrm, 0) AS l1
            FROM prior, tgt t LEFT JOIN tsum USING (row_id)),
    scored AS MATERIALIZED (SELECT row_id, l0, l1, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS prediction,
                      1.0::DOUBLE / (1.0::DOUBLE + exp(-abs(l1 - l0))) AS confidence FROM lik)"""
