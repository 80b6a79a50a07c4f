"""How distinctive a term is per record (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutor.llm.common import cut, join_term_stats
from statutor.llm.survivor import real_title


def terms(text: Column) -> Column:
    """The runs of four or more letters a-z of the lower-cased text, as an array (empty for null)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))


def distinctive_terms(df: DataFrame, key: str, texts: list[Column], prior: float = 500.0, most_records: int | None = None) -> DataFrame:
    """Rows (key, term, n_in_record, n_records, log_odds, z) for each distinct term of each record.

    Log-odds ratio of the record against the rest of the collection with an informative Dirichlet prior of total
    weight ``prior``, shared out by the collection's counts, divided by its standard error. ``n_records`` is how many
    distinct keys hold the term. Repeated rows of a key count once (a term's count is the greatest that one row gives
    it). Null keys are left out, null or empty texts have no terms; an empty table gives no rows. The collection's
    counts are aggregated before they are shuffled and joined back by ``join_term_stats``, so a term in every record is
    no hot key.

    With ``most_records`` only terms are kept whose z-score reaches that of a term which its record shares with so many
    others at most: the least of those of one that is said elsewhere once, and of one said as often as ``most_records`` - 1
    records can (the score first rises and then falls with that number, so it is least at its ends). A term in two to
    ``most_records`` records always reaches it; commoner ones mostly don't.
    """
    # rows are numbered before they are taken apart, so that a term's count is that of one row
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key), F.concat(*(terms(t) for t in texts)).alias("_terms"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.select(key, "_row", F.explode("_terms").alias("term"))
    each = cut(rows.groupBy(key, "_row", "term").agg(F.count("*").alias("c")).groupBy(key, "term").agg(F.max("c").alias("n_in_record")))
    sizes = each.groupBy(key).agg(F.sum("n_in_record").alias("_size"))
    stats = each.groupBy("term").agg(F.count("*").alias("n_records"), F.sum("n_in_record").alias("_all"))
    n_rows, total = stats.agg(F.coalesce(F.sum("n_records"), F.lit(0)), F.coalesce(F.sum("_all"), F.lit(0))).first()
    d = join_term_stats(each.join(sizes, key), stats, "term", "n_records", n_rows)
    y, n = F.col("n_in_record"), F.col("_size")
    odds, z = z_score(y, F.col("_all") - y, n, total, prior)
    floor = F.lit(float("-inf"))
    if most_records is not None:
        most = (most_records - 1) * each.agg(F.coalesce(F.max("n_in_record"), F.lit(1))).first()[0]
        floor = F.least(*(z_score(y, F.lit(k), n, total, prior)[1] for k in (1, most)))
    rows = d.select(key, "term", "n_in_record", "n_records", odds.alias("log_odds"), z.alias("z"), floor.alias("_floor"))
    return rows.filter(F.col("z") >= F.col("_floor") - 1e-9).drop("_floor")


def z_score(y: Column, rest: Column, n: Column, total: int, prior: float) -> tuple[Column, Column]:
    """Log-odds and z-score of a term said ``y`` times in a record of ``n`` terms and ``rest`` times elsewhere, of ``total``."""
    a0 = F.lit(float(prior))
    a = a0 * (y + rest) / F.lit(float(max(total, 1)))
    others = lambda c: F.greatest(c, F.lit(1e-9))  # noqa: E731  # none where one term is all there is
    odds = F.log((y + a) / others(n + a0 - y - a)) - F.log((rest + a) / others(F.lit(float(total)) - n + a0 - rest - a))
    return odds, odds / F.sqrt(1 / (y + a) + 1 / (rest + a))


def index_terms(corpus_index: DataFrame, most_records: int | None = None) -> DataFrame:
    """``distinctive_terms`` of ``corpus_index`` by ``scan_seq``, from the title (unless a stand-in) and the keywords."""
    title = F.when(real_title(F.col("title")), F.col("title"))
    return distinctive_terms(corpus_index, "scan_seq", [title, F.col("subject_keywords")], most_records=most_records)
