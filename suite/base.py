"""Registry of queries, and the derived views of ``riskloom.sources.adapter`` written in SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schema

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_PARTS: dict[str, tuple[list[str], str]] = {}


def query(sql: str | None = None, views: str = ""):
    """Registers a query under its function name, with its SQL if it has one."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_views(views.split(), sql)
        return fn
    return register


def with_views(names: list[str], sql: str) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        for dep in _PARTS[name][0]:
            add(dep)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    if not done:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n][1]})" for n in done) + "\n" + sql


def view(name: str, body: str, needs: str = "") -> None:
    _PARTS[name] = (needs.split(), body)


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates as ``YYYY-MM-DD`` text, so that both engines return the same type."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n, t in df.dtypes if t == "date"})


def long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def r6(c: str) -> Column:
    """Sums of doubles depend on their order, so they are compared to six decimals."""
    return F.round(F.col(c), 6).alias(c)


def tenths(part: str, whole: str) -> str:
    return (f"(case when {whole} > 0 then cast((2000*{part} + {whole}) // (2*{whole}) as double)"
            f" / cast(10 as double) else cast(0 as double) end)")


def hundredths(part: str, whole: str) -> str:
    return (f"(case when {whole} > 0 then cast((20000*{part} + {whole}) // (2*{whole}) as double)"
            f" / cast(100 as double) else cast(0 as double) end)")


def sql_ratio(part: str, whole: str) -> str:
    return (f"(case when {whole} > 0 then cast({part} as double) / cast({whole} as double)"
            f" else cast(0 as double) end)")


FEATURES = schema.REQUIRED

view("lines_of", """
  select l_orderkey, max(case when l_linestatus = 'F' then l_shipdate end) as last_f,
         count(*) filter (where l_returnflag = 'R') as returned
  from lineitem group by l_orderkey""")

view("card_base", """
  select o_orderkey as tx_id,
    case o_orderkey % 3 when 0 then 'clasica' when 1 then 'oro' else 'platinum' end as Tipo_tarjeta,
    case when o_orderstatus = 'P' and o_orderkey % 4 = 0 then 'vencida'
         when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'bloqueada'
         else 'activa' end as Estado_tarjeta,
    cast(cast(o_orderdate as date) + interval 3 year as date) as Fecha_vencimiento,
    cast(o_orderkey % 10 = 0 as int) as Indicador_repositorio,
    case when n_regionkey = 0 then 'internacional' else 'nacional' end as Localizacion_tarjeta,
    cast(floor(o_totalprice / cast(5000 as double)) as int) / cast(100 as double) as Acumulado_cupo,
    case when o_orderkey % 5 <> 0 then cast(last_f as date) end as Fecha_ult_retiro,
    cast(coalesce(returned, 0) as int) as Cuotas_mora,
    case when c_acctbal < 0 then 'castigada' when c_acctbal < 1000 then 'en mora'
         else 'al dia' end as Ind_estado,
    cast(o_orderpriority = '1-URGENT' as int) as Es_amparada,
    cast(o_orderkey % 7 = 0 as int) as Es_reexpedicion,
    case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'gobierno'
         when c_mktsegment in ('AUTOMOBILE', 'HOUSEHOLD') then 'privada'
         else 'independiente' end as Tipo_nomina,
    strftime(o_orderdate, '%Y-%m') as run_id
  from orders left join customer on o_custkey = c_custkey
    left join nation on c_nationkey = n_nationkey
    left join lines_of on o_orderkey = l_orderkey""", "lines_of")

RULES = {
    "bloqueada_reexpedida": "Estado_tarjeta = 'bloqueada' and Es_reexpedicion = 1",
    "mora_cupo_alto": "Cuotas_mora >= 3 and Acumulado_cupo > cast(0.9 as double)",
    "repositorio_internacional":
        "Indicador_repositorio = 1 and Localizacion_tarjeta = 'internacional'",
    "amparada_reexpedida": "Es_amparada = 1 and Es_reexpedicion = 1",
    "sin_retiro_no_activa": "Fecha_ult_retiro is null and Estado_tarjeta <> 'activa'",
    "independiente_mora": "Tipo_nomina = 'independiente' and Cuotas_mora > 4",
}

view("card_tx", "select *, cast((" + ") or (".join(RULES.values())
     + ") as int) as fraude from card_base", "card_base")

view("scored0", """
  select *, 3500*fraude + cast(floor(((tx_id*7919) % 1000) * 13 / cast(2 as double)) as int) as q
  from card_tx""", "card_tx")

view("scored", """
  select *, q / cast(10000 as double) as probabilidad, cast(q >= 5000 as int) as prediccion,
    case when q >= 5000 then '⚠️ Fraudulenta' else 'Legítima' end as clasificacion
  from scored0""", "scored0")

view("reviewed", """
  select *, case tx_id % 6 when 0 then 'verdadero_positivo' when 1 then 'falso_positivo' end
      as marcacion_usuario,
    case tx_id % 6 when 0 then 1 when 1 then 0 end as etiqueta_usuario
  from scored""", "scored")

view("feedback", """
  select ts, case when user_id % 5 <> 0 then 'analista_' || user_id end as usuario,
    event_id // 2 as indice,
    case event_type when 'click' then 'verdadero_positivo' when 'view' then 'falso_positivo'
         else 'dudoso' end as marcacion, event_id as seq
  from events""")

view("required", "select * from (values "
     + ", ".join(f"({i}, '{r}')" for i, r in enumerate(schema.REQUIRED)) + ") t(slot, required)")

view("synonyms", "select * from (values " + ", ".join(
    f"({i}, '{r}', {j}, {len(schema.SYNONYMS[r])}, '{s}')"
    for i, r in enumerate(schema.REQUIRED) for j, s in enumerate(schema.SYNONYMS[r]))
    + ") t(slot, required, idx, n_syn, synonym)")

view("header_raw", """
  select l_orderkey, l_linenumber, o_custkey, o_custkey % 10 as style, l_suppkey,
    l_partkey % (case when o_custkey % 10 between 1 and 3 then 4
                      when o_custkey % 10 between 4 and 5 then 8 else 12 end) as slot,
    cast(l_quantity as int) % 6 as kind, p_name, p_type
  from lineitem join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey""")

view("headers", """
  select 'cliente_' || o_custkey as file_id, l_orderkey*16 + l_linenumber as pos,
    case when style = 0 then r.required
         when style = 9 then 'campo ' || p_name
         when kind = 0 then upper(synonym)
         when kind = 1 then replace(synonym, '_', ' - ')
         when kind = 2 then r.required || '_' || split_part(p_name, ' ', 1)
         when kind = 3 then split_part(r.required, '_', -1) || '_' || split_part(r.required, '_', 1)
         when kind = 4 then p_name || '_' || p_type
         else translate(synonym, 'aeiou', 'áéíóú') end as name
  from header_raw h join required r on h.slot = r.slot
    join synonyms s on s.slot = h.slot and s.idx = h.l_suppkey % s.n_syn""",
     "header_raw required synonyms")


def sql_normalise(c: str) -> str:
    return (f"regexp_replace(regexp_replace(strip_accents(regexp_replace(lower({c}),"
            f" '^\\s+|\\s+$', '', 'g')), '[\\s\\-.]+', '_', 'g'), '[^a-z0-9_]', '', 'g')")


def sql_grams(c: str) -> str:
    return f"list_distinct([substr({c}, i, 2) for i in range(1, length({c}))])"


def sql_similarity(a: str, b: str, ga: str, gb: str, shortest: int) -> str:
    shared = f"len(list_intersect({ga}, {gb}))"
    return (f"case when {a} = {b} then cast(1 as double)"
            f" when (contains({a}, {b}) or contains({b}, {a}))"
            f" and least(length({a}), length({b})) >= {shortest} then cast(0.85 as double)"
            f" when len({ga}) = 0 or len({gb}) = 0 then cast(0 as double)"
            f" else cast({shared} as double) / (len({ga}) + len({gb}) - {shared}) end")


view("norms", f"select distinct name, {sql_normalise('name')} as norm from headers", "headers")
view("grams", f"select name, norm, {sql_grams('norm')} as g from norms", "norms")
view("wanted", "select slot, required, lower(required) as rn, "
     f"{sql_grams('lower(required)')} as rg from required", "required")
view("spelled", f"select distinct required, {sql_normalise('synonym')} as syn from synonyms",
     "synonyms")
view("scores", f"""
  select name, w.required, case when name = w.required then 1 when s.syn is not null then 2
      else 3 end as prio,
    case when name = w.required then cast(1 as double)
         when s.syn is not null then cast(0.95 as double)
         else {sql_similarity('rn', 'norm', 'rg', 'g', 2)} end as score
  from grams cross join wanted w left join spelled s on s.required = w.required
    and s.syn = norm""", "grams wanted spelled")
view("best", """
  select file_id, required, name, score, prio from (
    select file_id, required, h.name, score, prio, row_number() over (
      partition by file_id, required order by prio, score desc, pos, h.name) as k
    from headers h join scores c on h.name = c.name where score >= cast(0.60 as double))
  where k = 1""", "headers scores")

view("models", """
  select 'modelo_' || s_suppkey || case s_suppkey % 10 when 3 then '_anterior'
      when 7 then '_Backup' else '' end || '.joblib' as nombre,
    s_suppkey % 8 + 1 as version, s_nationkey < 6 as es_original,
    strftime(date '2024-01-01' + cast(s_suppkey * 37 % 365 as int), '%Y-%m-%d') as fecha
  from supplier""")

view("model_scores", """
  select modelo, tx_id, fraude, q, cast(q >= 5000 as int) as prediccion from (
    select 'modelo_' || l_suppkey || case l_suppkey % 10 when 3 then '_anterior'
        when 7 then '_Backup' else '' end || '.joblib' as modelo, tx_id, fraude,
      greatest(0, least(10000, q + cast((tx_id*31 + l_suppkey*17) % 4001 as int) - 2000)) as q
    from scored join lineitem on tx_id = l_orderkey)""", "scored")


def sql_report(source: str, by: str = "") -> str:
    """Long classification report of a view with columns fraude, prediccion."""
    keys = f"{by}, " if by else ""
    counts = f"""(select {keys}
        count(*) filter (where fraude=1 and prediccion=1) as tp,
        count(*) filter (where fraude=0 and prediccion=1) as fp,
        count(*) filter (where fraude=0 and prediccion=0) as tn,
        count(*) filter (where fraude=1 and prediccion=0) as fn
      from {source} {'group by ' + by if by else ''})"""
    zero = {"precision": sql_ratio("tn", "(tn+fn)"), "recall": sql_ratio("tn", "(tn+fp)"),
            "f1-score": sql_ratio("2*tn", "(2*tn+fn+fp)")}
    one = {"precision": sql_ratio("tp", "(tp+fp)"), "recall": sql_ratio("tp", "(tp+fn)"),
           "f1-score": sql_ratio("2*tp", "(2*tp+fp+fn)")}
    rows = []
    for m in zero:
        rows += [("0", m, zero[m]), ("1", m, one[m]),
                 ("macro avg", m, f"({zero[m]} + {one[m]}) / 2"),
                 ("weighted avg", m, f"case when tp+fp+tn+fn > 0 then ({zero[m]}*(tn+fp)"
                                     f" + {one[m]}*(tp+fn)) / (tp+fp+tn+fn) else 0 end")]
    rows += [("0", "support", "tn+fp"), ("1", "support", "tp+fn"),
             ("macro avg", "support", "tp+fp+tn+fn"), ("weighted avg", "support", "tp+fp+tn+fn"),
             ("accuracy", "accuracy", sql_ratio("(tp+tn)", "(tp+fp+tn+fn)"))]
    return " union all ".join(
        f"select {keys}'{c}' as clase, '{m}' as metrica, cast({v} as double) as valor"
        f" from {counts}" for c, m, v in rows)


def sql_curve(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""select {keys}umbral, p, n,
        sum(p) over ({part} order by umbral desc) as tp,
        sum(n) over ({part} order by umbral desc) as fp,
        sum(p) over ({part}) as pos, sum(n) over ({part}) as neg
      from (select {keys}q as umbral, count(*) filter (where fraude=1) as p,
              count(*) filter (where fraude=0) as n from {source} group by {keys}q)"""


view("curve", sql_curve("scored"), "scored")
view("model_curve", sql_curve("model_scores", "modelo"), "model_scores")

AUC = ("cast(sum(n*(2*tp-p)) as double) / nullif(cast(2*cast(max(pos) as hugeint)*max(neg)"
       " as double), 0)")
AP = "sum(p * (cast(tp as double) / (tp+fp))) / nullif(max(pos), 0)"
