"""Token counting with the regular-expression counter: a run of letters, digits and underscores, or one other visible character."""

from pyspark.sql import Column, functions as F

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_count(text: Column) -> Column:
    """Tokens of a text: 0 for null or empty, else at least 1."""
    n = F.regexp_count(text, F.lit(TOKEN)).cast("bigint")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(n, F.lit(1).cast("bigint")))


def percentage(value: Column, total: Column) -> Column:
    """Share in percent, 4 places; 0.0 if there is no total."""
    return F.when(total > 0, F.round(F.lit(100.0) * value.cast("double") / total.cast("double"), 4)).otherwise(F.lit(0.0))
