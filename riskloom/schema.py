"""Column names, types and fixed texts of the card-transaction data model."""

from pyspark.sql import types as T

# --- Fixed values: required and optional input columns -----------------------------------------
REQUIRED = [
    "Tipo_tarjeta",
    "Estado_tarjeta",
    "Fecha_vencimiento",
    "Indicador_repositorio",
    "Localizacion_tarjeta",
    "Acumulado_cupo",
    "Fecha_ult_retiro",
    "Cuotas_mora",
    "Ind_estado",
    "Es_amparada",
    "Es_reexpedicion",
    "Tipo_nomina",
]
OPTIONAL = ["Numero_tarjeta", "fraude", "fraude_true", "es_etiqueta_ruidosa", "Ubicacion"]

# --- Fixed values: known spellings of the required columns -------------------------------------
SYNONYMS = {
    "Tipo_tarjeta": [
        "tipo_tarjeta", "tipotarjeta", "tipo tarjeta", "type_card", "card_type",
        "tipo de tarjeta", "tipo_de_tarjeta",
    ],
    "Estado_tarjeta": [
        "estado_tarjeta", "estadotarjeta", "estado tarjeta", "card_status", "status_card",
        "estado", "status", "estado_de_tarjeta",
    ],
    "Fecha_vencimiento": [
        "fecha_vencimiento", "fechavencimiento", "fecha vencimiento", "expiry_date",
        "expiration_date", "vencimiento", "fecha_exp", "fecha_de_vencimiento", "expiry",
    ],
    "Indicador_repositorio": [
        "indicador_repositorio", "indicadorrepositorio", "indicador repositorio", "repositorio",
        "ind_repo", "indicator_repo", "repositorio_indicator",
    ],
    "Localizacion_tarjeta": [
        "localizacion_tarjeta", "localizacion", "localizacion tarjeta", "location",
        "card_location", "ubicacion_tarjeta", "localización_tarjeta", "localizacion_de_tarjeta",
    ],
    "Acumulado_cupo": [
        "acumulado_cupo", "acumuladocupo", "acumulado cupo", "cupo_acumulado",
        "accumulated_quota", "cupo", "quota", "limite_usado", "used_limit",
    ],
    "Fecha_ult_retiro": [
        "fecha_ult_retiro", "fechaultretiro", "fecha ult retiro", "last_withdrawal_date",
        "ultimo_retiro", "fecha_ultimo_retiro", "last_withdrawal", "fecha_ultimo_movimiento",
    ],
    "Cuotas_mora": [
        "cuotas_mora", "cuotasmora", "cuotas mora", "past_due_installments", "mora",
        "overdue_payments", "cuotas_vencidas", "installments_overdue",
    ],
    "Ind_estado": [
        "ind_estado", "indestado", "ind estado", "status_indicator", "indicador_estado",
        "estado_indicador", "payment_status",
    ],
    "Es_amparada": [
        "es_amparada", "esamparada", "es amparada", "is_insured", "amparada", "insured",
        "covered", "is_covered",
    ],
    "Es_reexpedicion": [
        "es_reexpedicion", "esreexpedicion", "es reexpedicion", "is_reissued", "reexpedicion",
        "reissued", "reexpedida", "es_reexpedida",
    ],
    "Tipo_nomina": [
        "tipo_nomina", "tiponómina", "tipo nomina", "payroll_type", "nomina", "payroll",
        "tipo_de_nomina", "tipo de nómina",
    ],
}

# --- Fixed values: columns that never reach a model --------------------------------------------
# One list for scoring and training; it also holds the reviewer's label and the error tag, which
# would leak the answer when reviewed runs are fed back into training.
CONTROL = [
    "fraude", "fraude_true", "es_etiqueta_ruidosa", "Numero_tarjeta", "prediccion",
    "probabilidad", "clasificacion", "marcacion_usuario", "es_outlier", "Ubicacion",
    "resultado", "etiqueta_usuario", "tipo_error",
]
TEXT_FEATURES = [
    "Tipo_tarjeta", "Estado_tarjeta", "Fecha_vencimiento", "Localizacion_tarjeta", "Ind_estado",
    "Tipo_nomina", "Fecha_ult_retiro", "Ubicacion",
]
DATE_COLUMNS = ["Fecha_vencimiento", "Fecha_ult_retiro"]
UNKNOWN = "desconocido"

# --- Fixed values: verdict and display texts ---------------------------------------------------
MARK_TRUE = "verdadero_positivo"
MARK_FALSE = "falso_positivo"
CLASS_FRAUD, CLASS_LEGIT = "⚠️ Fraudulenta", "Legítima"
LABEL_FRAUD, LABEL_LEGIT, LABEL_NONE = "✔ Fraude (1)", "✔ Legítima (0)", "— sin revisar"
OUTCOMES = {
    (1, 1): "✅ Verdadero Positivo",
    (0, 1): "❌ Falso Positivo",
    (0, 0): "✅ Verdadero Negativo",
    (1, 0): "❌ Falso Negativo",
}
ERROR_TAGS = {(1, 0): "⚠️ Falso Negativo", (0, 1): "❌ Falso Positivo"}
MAPPING_TEXTS = {
    "ok": "Todas las columnas coinciden.",
    "auto": "Se detectaron %d columnas con nombres diferentes y se renombraron automáticamente.",
    "parcial": "Se encontraron %d de %d columnas. Faltan %d: necesitamos que las asignes"
               " manualmente.",
    "vacio": "Solo se encontraron %d columnas. Necesitamos asignar %d manualmente.",
    "imposible": "No se pudo detectar ninguna columna requerida en el archivo.",
}
REPORT_COLUMNS = [
    "Timestamp_reporte", "Numero_tarjeta", "Tipo_tarjeta", "Estado_tarjeta", "Acumulado_cupo",
    "Cuotas_mora", "Localizacion_tarjeta", "probabilidad", "clasificacion", "marcacion_usuario",
]
PREVIEW_COLUMNS = ["Estado_tarjeta", "Localizacion_tarjeta", "Cuotas_mora", "probabilidad",
                   "clasificacion"]

# --- Fixed values: training profiles (trees, depth, row budget of the base set) -----------------
PROFILES = {
    "rapido": {"trees": 150, "depth": 20, "max_rows": 30_000},
    "balanceado": {"trees": 250, "depth": None, "max_rows": 80_000},
    "completo": {"trees": 400, "depth": None, "max_rows": None},
}
GRID = {"trees": [200, 400], "depth": [None, 10, 20], "min_split": [2, 5]}

CARD_TX = T.StructType([
    T.StructField("Numero_tarjeta", T.StringType()),
    T.StructField("Tipo_tarjeta", T.StringType()),
    T.StructField("Estado_tarjeta", T.StringType()),
    T.StructField("Fecha_vencimiento", T.DateType()),
    T.StructField("Indicador_repositorio", T.IntegerType()),
    T.StructField("Localizacion_tarjeta", T.StringType()),
    T.StructField("Acumulado_cupo", T.DoubleType()),
    T.StructField("Fecha_ult_retiro", T.DateType()),
    T.StructField("Cuotas_mora", T.IntegerType()),
    T.StructField("Ind_estado", T.StringType()),
    T.StructField("Es_amparada", T.IntegerType()),
    T.StructField("Es_reexpedicion", T.IntegerType()),
    T.StructField("Tipo_nomina", T.StringType()),
])

TEMPLATE_ROWS = [
    ("A1B2C3", "clasica", "activa", "2026-08-15", 0, "nacional", 0.35, "2025-08-01", 0,
     "al dia", 0, 0, "privada"),
    ("D4E5F6", "oro", "bloqueada", "2024-03-10", 1, "internacional", 0.95, "", 4,
     "en mora", 1, 1, "independiente"),
]


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


SCORE_FIELDS = [
    field("prediccion", T.IntegerType()),
    field("probabilidad", T.DoubleType()),
    field("clasificacion", T.StringType()),
]

FEEDBACK = T.StructType([
    field("timestamp", T.TimestampNTZType()),
    field("usuario", T.StringType()),
    field("indice", T.LongType()),
    field("marcacion", T.StringType()),
])

DATASETS = T.StructType([
    field("nombre", T.StringType()),
    field("nombre_orig", T.StringType()),
    field("descripcion", T.StringType()),
    field("ruta", T.StringType()),
    field("fecha", T.StringType()),
    field("filas", T.LongType()),
    field("columnas", T.LongType()),
    field("tiene_fraude", T.BooleanType()),
    field("n_fraudes", T.LongType()),
])

RUNS = T.StructType([
    field("nombre", T.StringType()),
    field("archivo", T.StringType()),
    field("fecha", T.StringType()),
    field("modelo", T.StringType()),
    field("database", T.StringType()),
    field("n_filas", T.LongType()),
    field("n_fraudes", T.LongType()),
    field("n_legitimas", T.LongType()),
    field("pct_fraude", T.DoubleType()),
    field("tiene_gt", T.BooleanType()),
    field("n_errores", T.LongType()),
    field("n_revisadas", T.LongType()),
    field("pct_revision", T.DoubleType()),
    field("revision_completa", T.BooleanType()),
])

MODELS = T.StructType([
    field("nombre", T.StringType()),
    field("version", T.LongType()),
    field("ruta", T.StringType()),
    field("es_original", T.BooleanType()),
    field("fecha", T.StringType()),
])

_PER_CLASS = T.StructType([
    field("precision", T.DoubleType()),
    field("recall", T.DoubleType()),
    field("f1-score", T.DoubleType()),
    field("support", T.DoubleType()),
])

METRICS = T.StructType([
    field("modelo", T.StringType()),
    field("roc_auc", T.DoubleType()),
    field("pr_auc", T.DoubleType()),
    field("classification_report", T.StructType([
        field("0", _PER_CLASS),
        field("1", _PER_CLASS),
        field("accuracy", T.DoubleType()),
        field("macro avg", _PER_CLASS),
        field("weighted avg", _PER_CLASS),
    ])),
    field("reentrenado_el", T.StringType()),
    field("n_errores_incorporados", T.LongType()),
    field("complejidad", T.StringType()),
    field("best_params", T.StructType([
        field("n_estimators", T.LongType()),
        field("max_depth", T.StringType()),
    ])),
])
