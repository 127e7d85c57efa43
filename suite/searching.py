"""Text search through the index of stored runs."""

from riskloom import schema
from riskloom.operators import searchindex
from riskloom.session import scratch_path
from riskloom.sources import adapter
from suite.base import dates_as_text, query

_COLUMNS = [c for c in schema.REQUIRED if c != "Acumulado_cupo"]
_TEXTS = ", ".join(f"strftime({c}, '%Y-%m-%d') as {c}" if c in schema.DATE_COLUMNS else f"cast({c} as varchar) as {c}" for c in _COLUMNS)


_DAYS = r"1997-06-1\d"


@query(f"select tx_id from (select tx_id, {_TEXTS} from card_tx) where " + " or ".join(
    f"coalesce(regexp_matches({c}, '(?i){_DAYS}'), false)" for c in _COLUMNS), "card_tx")
def indexed_search(spark, sf_dir):
    """Transactions lie in files by their last withdrawal; the dates of a few days are in few files."""
    path = scratch_path(spark, "run")
    rows = dates_as_text(adapter.card_tx(spark, sf_dir))
    rows.repartitionByRange(40, "Fecha_ult_retiro").write.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    searchindex.build_index(stored, f"{path}/index", _COLUMNS)
    return searchindex.search_indexed(spark, stored, f"{path}/index", _DAYS, _COLUMNS).select("tx_id")
