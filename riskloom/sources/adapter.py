"""Views in the shape of the card data model over a star schema of orders.

The supplied tables hold no cards. These views derive transactions, header names, analyst
verdicts, runs and competing models from them, with whole-number arithmetic so that every
engine gets the same rows. All of them grow with the tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schema
from riskloom.functions.labels import class_text, rule_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def card_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order, with the rule label ``fraude`` and its month as ``run_id``."""
    key = F.col("o_orderkey")
    lines = (table(spark, sf_dir, "lineitem")
             .filter("l_linestatus = 'F' or l_returnflag = 'R'")
             .groupBy("l_orderkey").agg(
                 F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("_last"),
                 F.count_if(F.col("l_returnflag") == "R").alias("_returned")))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer")
    joined = (table(spark, sf_dir, "orders")
              .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
              .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
              .join(lines, key == F.col("l_orderkey"), "left"))

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    status = F.col("o_orderstatus")
    segment = F.col("c_mktsegment")
    base = joined.select(
        key.alias("tx_id"),
        F.element_at(F.array(*[F.lit(v) for v in ("clasica", "oro", "platinum")]),
                     (key % 3 + 1).cast("int")).alias("Tipo_tarjeta"),
        F.when((status == "P") & (key % 4 == 0), "vencida")
        .when((status == "F") & (key % 2 == 0), "bloqueada").otherwise("activa")
        .alias("Estado_tarjeta"),
        F.add_months(F.to_date("o_orderdate"), 36).alias("Fecha_vencimiento"),
        flag(key % 10 == 0).alias("Indicador_repositorio"),
        F.when(F.col("n_regionkey") == 0, "internacional").otherwise("nacional")
        .alias("Localizacion_tarjeta"),
        (F.floor(F.col("o_totalprice") / 5000).cast("int") / F.lit(100.0)).alias("Acumulado_cupo"),
        F.when(key % 5 != 0, F.to_date("_last")).alias("Fecha_ult_retiro"),
        F.coalesce(F.col("_returned"), F.lit(0)).cast("int").alias("Cuotas_mora"),
        F.when(F.col("c_acctbal") < 0, "castigada").when(F.col("c_acctbal") < 1000, "en mora")
        .otherwise("al dia").alias("Ind_estado"),
        flag(F.col("o_orderpriority") == "1-URGENT").alias("Es_amparada"),
        flag(key % 7 == 0).alias("Es_reexpedicion"),
        F.when(segment.isin("BUILDING", "MACHINERY"), "gobierno")
        .when(segment.isin("AUTOMOBILE", "HOUSEHOLD"), "privada").otherwise("independiente")
        .alias("Tipo_nomina"),
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"),
    )
    return base.withColumn("fraude", rule_label())


def scored_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a score ``q`` of 1/10,000 that needs no model, and its class."""
    noise = F.floor(((F.col("tx_id") * 7919) % 1000) * 13 / F.lit(2.0)).cast("int")
    q = F.lit(3500) * F.col("fraude") + noise
    return (card_tx(spark, sf_dir).withColumn("q", q)
            .withColumn("probabilidad", F.col("q") / F.lit(10000.0))
            .withColumn("prediccion", (F.col("q") >= 5000).cast("int"))
            .withColumn("clasificacion", class_text(F.col("prediccion"))))


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "events"))


def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts as a stream over the files of the events."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    kind = spark.read.parquet(path).schema
    # a pattern, as a stream reads no path of a single file
    return verdicts(spark.readStream.schema(kind).parquet(path[:-1] + "[t]"))


def verdicts(events: DataFrame) -> DataFrame:
    """Analyst verdicts from events: two events in a row judge the same transaction."""
    event = F.col("event_type")
    mark = (F.when(event == "click", schema.MARK_TRUE).when(event == "view", schema.MARK_FALSE)
            .otherwise("dudoso"))
    user = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("analista_"),
                                                      F.col("user_id").cast("string")))
    return events.select(
        F.col("ts").alias("timestamp"), user.alias("usuario"),
        F.floor(F.col("event_id") / 2).cast("long").alias("indice"), mark.alias("marcacion"),
        F.col("event_id").alias("seq"))


def reviewed_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored transactions with one given verdict per row: confirmed, refuted or none."""
    key = F.col("tx_id") % 6
    mark = F.when(key == 0, schema.MARK_TRUE).when(key == 1, schema.MARK_FALSE)
    return scored_tx(spark, sf_dir).withColumn("marcacion_usuario", mark).withColumn(
        "etiqueta_usuario", F.when(key == 0, 1).when(key == 1, 0))


def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names of uploaded files ``(file_id, pos, name)``: a file per customer, a column
    per order line, spelled as a required name, a known spelling, a variant of one, or a word
    that means nothing."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    style = F.col("o_custkey") % 10
    reach = F.when(style.between(1, 3), 4).when(style.between(4, 5), 8).otherwise(12)
    sizes = F.array(*[F.lit(len(schema.SYNONYMS[r])) for r in schema.REQUIRED])
    slot = (F.col("l_partkey") % reach).cast("int")
    words = spark.createDataFrame(
        [(i, j, r, s) for i, r in enumerate(schema.REQUIRED)
         for j, s in enumerate(schema.SYNONYMS[r])],
        "slot int, place int, required string, spelling string")
    joined = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
              .withColumn("slot", slot)
              .withColumn("place", (F.col("l_suppkey") % F.element_at(
                  sizes, F.col("slot") + 1)).cast("int"))
              .join(F.broadcast(words), ["slot", "place"]))
    required, spelling = F.col("required"), F.col("spelling")
    kind = (F.col("l_quantity").cast("int") % 6)
    word = F.substring_index(F.coalesce(F.col("p_name"), F.lit("x y")), " ", 1)
    variant = (F.when(kind == 0, F.upper(spelling))
               .when(kind == 1, F.regexp_replace(spelling, "_", " - "))
               .when(kind == 2, F.concat_ws("_", required, word))
               .when(kind == 3, F.concat_ws("_", F.substring_index(required, "_", -1),
                                            F.substring_index(required, "_", 1)))
               .when(kind == 4, F.concat_ws("_", F.col("p_name"), F.col("p_type")))
               .otherwise(F.translate(spelling, "aeiou", "áéíóú")))
    name = (F.when(style == 0, required)
            .when(style == 9, F.concat(F.lit("campo "), F.col("p_name"))).otherwise(variant))
    return joined.select(
        F.concat(F.lit("cliente_"), F.col("o_custkey").cast("string")).alias("file_id"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pos"),
        F.coalesce(name, F.lit("")).alias("name"))


def manual_choices(names: DataFrame) -> DataFrame:
    """A user's answers for every required column of every file: its first column, a skip, or
    a column that does not exist."""
    first = names.groupBy("file_id").agg(F.min_by("name", F.struct("pos", "name")).alias("_first"))
    wanted = F.posexplode(F.array(*[F.lit(r) for r in schema.REQUIRED])).alias("_i", "required")
    answer = (F.when(F.col("_i") % 3 == 0, F.col("_first")).when(F.col("_i") % 3 == 1, "__omitir__")
              .otherwise("no_existe"))
    return first.select("file_id", "_first", wanted).select("file_id", "required",
                                                            answer.alias("name"))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model per supplier, with its file name, origin and date."""
    key = F.col("s_suppkey")
    kind = F.when(key % 10 == 3, "_anterior").when(key % 10 == 7, "_Backup").otherwise("")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("modelo_"), key.cast("string"), kind, F.lit(".joblib")).alias("nombre"),
        (key % 8 + 1).alias("version"),
        F.concat(F.lit("modelos/"), key.cast("string")).alias("ruta"),
        (F.col("s_nationkey") < 6).alias("es_original"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key * 37 % 365).cast("int")),
                      "yyyy-MM-dd").alias("fecha"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every model on the transactions with a line from its supplier."""
    key, supp = F.col("tx_id"), F.col("l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    shift = ((key * 31 + supp * 17) % 4001).cast("int") - 2000
    kind = F.when(supp % 10 == 3, "_anterior").when(supp % 10 == 7, "_Backup").otherwise("")
    scored = scored_tx(spark, sf_dir).select("tx_id", "fraude", "q").join(
        lines, key == F.col("l_orderkey"))
    q = F.greatest(F.lit(0), F.least(F.lit(10000), F.col("q") + shift))
    return scored.select(
        F.concat(F.lit("modelo_"), supp.cast("string"), kind, F.lit(".joblib")).alias("modelo"),
        "tx_id", "fraude", q.alias("q")).withColumn(
        "prediccion", (F.col("q") >= 5000).cast("int"))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows, one per month of transactions; the months before 1993 carry no truth."""
    from riskloom.operators.review import run_summary

    labelled = F.col("run_id") >= "1993-01"
    rows = run_summary(reviewed_tx(spark, sf_dir), ["run_id"])
    month = F.substring("run_id", 6, 2).cast("int")
    return rows.select(
        F.concat(F.lit("analisis "), F.col("run_id")).alias("nombre"),
        F.concat(F.lit("analisis_"), F.col("run_id"), F.lit(".csv")).alias("archivo"),
        F.concat(F.col("run_id"), F.lit("-01 00:00:00")).alias("fecha"),
        F.concat(F.lit("Modelo_"), (month % 4).cast("string")).alias("modelo"),
        F.concat(F.lit("tx_"), F.translate("run_id", "-", "_"), F.lit(".csv")).alias("database"),
        "n_filas", "n_fraudes", "n_legitimas", "pct_fraude", labelled.alias("tiene_gt"),
        "n_errores", "n_revisadas", "pct_revision",
        (labelled & (F.col("n_revisadas") * 3 >= F.col("n_errores") * 4)).alias(
            "revision_completa"))
