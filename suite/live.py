"""Review state from a stream of verdicts."""

from pyspark.sql import functions as F

from riskloom.session import scratch_path
from riskloom.sources import adapter
from riskloom.streaming import review
from suite.base import query, tenths


@query(f"""select run_id, n_errores, n_revisadas, n_err_revisadas,
    {tenths('n_revisadas', 'n_errores')} as pct_revision,
    cast(n_errores > 0 and n_revisadas >= n_errores as int) as revision_completa,
    cast(n_revisadas > 0 as int) as puede_reentrenar
  from (select run_id, count(*) filter (where fraude <> prediccion) as n_errores,
      count(indice) as n_revisadas, count(indice) filter (where fraude <> prediccion) as n_err_revisadas
    from scored left join (select distinct indice from feedback) f on tx_id = indice
    group by run_id)""", "scored feedback")
def live_review(spark, sf_dir):
    scored = adapter.scored_tx(spark, sf_dir)
    order = [F.unix_micros(F.col("timestamp").cast("timestamp")), F.col("seq")]
    root = scratch_path(spark, "live")
    changes = review.changed_marks(adapter.feedback_stream(spark, sf_dir), order)
    run = review.write_changes(changes, scored, f"{root}/moves", f"{root}/progress")
    run.awaitTermination()
    return review.live_state(spark, scored, f"{root}/moves")
