"""Column expressions for labels, outcomes and ratios."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import schema


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent_tenths(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, rounded half up in integers (no floating ties)."""
    twice = part.cast("long") * 2000 + whole
    return F.when(whole > 0, ((twice - twice % (whole * 2)) / (whole * 2)) / 10.0).otherwise(
        F.lit(0.0))


def percent_hundredths(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, rounded half up in integers."""
    twice = part.cast("long") * 20000 + whole
    return F.when(whole > 0, ((twice - twice % (whole * 2)) / (whole * 2)) / 100.0).otherwise(
        F.lit(0.0))


def fraud_rules() -> dict[str, Column]:
    """The six fraud rules, each false where a needed value is missing."""
    estado, reexp = F.col("Estado_tarjeta"), F.col("Es_reexpedicion")
    mora = F.col("Cuotas_mora")
    rules = {
        "bloqueada_reexpedida": (estado == "bloqueada") & (reexp == 1),
        "mora_cupo_alto": (mora >= 3) & (F.col("Acumulado_cupo") > 0.9),
        "repositorio_internacional": (F.col("Indicador_repositorio") == 1)
        & (F.col("Localizacion_tarjeta") == "internacional"),
        "amparada_reexpedida": (F.col("Es_amparada") == 1) & (reexp == 1),
        "sin_retiro_no_activa": F.col("Fecha_ult_retiro").isNull()
        & ~estado.eqNullSafe(F.lit("activa")),
        "independiente_mora": (F.col("Tipo_nomina") == "independiente") & (mora > 4),
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def rule_label() -> Column:
    """1 where any rule fires."""
    hit = F.lit(False)
    for rule in fraud_rules().values():
        hit = hit | rule
    return hit.cast("int")


def effective_label(columns: list[str]) -> Column:
    """The clean label if the frame has one, else the plain label; missing counts as 0."""
    source = "fraude_true" if "fraude_true" in columns else "fraude"
    return F.coalesce(F.col(source).cast("double").cast("int"), F.lit(0))


def class_text(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit(schema.CLASS_FRAUD)).otherwise(
        F.lit(schema.CLASS_LEGIT))


def reviewer_text(label: Column) -> Column:
    return (F.when(label == 1, F.lit(schema.LABEL_FRAUD))
            .when(label == 0, F.lit(schema.LABEL_LEGIT))
            .otherwise(F.lit(schema.LABEL_NONE)))


def outcome_text(truth: Column, prediction: Column) -> Column:
    text = F.lit("—")
    for (t, p), label in schema.OUTCOMES.items():
        text = F.when((truth == t) & (prediction == p), F.lit(label)).otherwise(text)
    return text


def error_tag(truth: Column, prediction: Column) -> Column:
    """Kind of error, null for rows that were predicted right."""
    tag = F.lit(None).cast("string")
    for (t, p), label in schema.ERROR_TAGS.items():
        tag = F.when((truth == t) & (prediction == p), F.lit(label)).otherwise(tag)
    return tag


def mark_label(mark: Column) -> Column:
    """1 for a confirmed fraud, 0 for any other mark, null without a mark."""
    return F.when(mark == schema.MARK_TRUE, 1).when(mark.isNotNull(), 0)


def imbalance_verdict(pct: Column) -> Column:
    return F.when(pct < 5, F.lit("desbalanceado")).when(pct > 50, F.lit("inusual"))


def tenthousandths(probability: Column) -> Column:
    """Probability as a whole number of 1/10,000, the grid it is published on."""
    return F.round(probability * 10000).cast("int")
