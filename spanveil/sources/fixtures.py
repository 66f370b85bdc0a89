"""Notes with known identifiers, built from key columns by SQL that Spark and DuckDB both read.

``NOTES_SQL`` gives (note_id, text) and one column for each value; ``GOLD_SQL`` the
offsets of the values in the text. Every fifth note's tax number has a wrong check digit,
every seventh note begins with a character outside the basic plane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _pad(value: str, n: int) -> str:
    return f"lpad(CAST({value} AS STRING), {n}, '0')"


def _fold(digits: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({digits}, {i}, 1) AS INT) * {w}" for i, w in enumerate(weights, 1)) + ")"


_BASE = _pad("(k * 7919 + 100000007) % 1000000000", 9)
_COMPANY = _pad("(k * 104729 + 10000019) % 100000000", 8) + " || '0001'"
_CARD = "'1' || " + _pad("(k * 7907 + 20000003) % 10000000000", 10)

_TWO = _fold("b13", [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) + " % 11"
_ONE = _fold("b12", [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) + " % 11"
#: Tax numbers of people and companies and health cards of keys(k), with their check digits; each step reads the one before.
STEPS = {
    "bases": f"SELECT k, {_BASE} AS b9, {_COMPANY} AS b12, {_CARD} AS b11 FROM keys",
    "sums": f"SELECT *, {_fold('b9', list(range(10, 1, -1)))} * 10 % 11 % 10 AS d1, {_ONE} AS r1, {_fold('b11', list(range(15, 4, -1)))} AS cs FROM bases",
    "firsts": "SELECT *, b9 || CAST(d1 AS STRING) AS b10, b12 || CAST(CASE WHEN r1 < 2 THEN 0 ELSE 11 - r1 END AS STRING) AS b13, 11 - cs % 11 AS cdv FROM sums",
    "seconds": f"SELECT *, {_fold('b10', list(range(11, 1, -1)))} * 10 % 11 % 10 AS d2, {_TWO} AS r2 FROM firsts",
    "numbers": """SELECT k, b10 || CAST(d2 AS STRING) AS cpf, b13 || CAST(CASE WHEN r2 < 2 THEN 0 ELSE 11 - r2 END AS STRING) AS cnpj,
  b11 || CASE WHEN cdv = 11 THEN '0000' WHEN cdv = 10 THEN '001' || CAST((11 - (cs + 2) % 11) % 11 AS STRING) ELSE '000' || CAST(cdv AS STRING) END AS cns FROM seconds""",
}

_DOTTED = "substr(cpf, 1, 3) || '.' || substr(cpf, 4, 3) || '.' || substr(cpf, 7, 3) || '-' || substr(cpf, 10, 1) || "
#: The values of a note, one column each.
VALUES_SQL = f"""
SELECT k AS note_id,
  CASE WHEN k % 7 = 0 THEN '😀 ' ELSE '' END AS lead,
  CASE k % 4 WHEN 0 THEN 'Maria Clara' WHEN 1 THEN 'João Pedro' WHEN 2 THEN 'ANA LÚCIA' ELSE 'Luís F.' END || ' ' || CASE k % 3 WHEN 0 THEN 'de Souza' WHEN 1 THEN 'Prado' ELSE 'dos Santos Lima' END AS person,
  CASE WHEN k % 5 = 0 THEN {_DOTTED} CAST((CAST(substr(cpf, 11, 1) AS INT) + 1) % 10 AS STRING) ELSE {_DOTTED} substr(cpf, 11, 1) END AS cpf,
  k % 5 <> 0 AS cpf_ok,
  '(' || {_pad("k % 89 + 11", 2)} || ') 9' || {_pad("k * 37 % 10000", 4)} || '-' || {_pad("k * 91 % 10000", 4)} AS phone,
  {_pad("k % 28 + 1", 2)} || '/' || {_pad("k % 12 + 1", 2)} || '/' || CAST(1940 + k % 70 AS STRING) AS born,
  CAST(k % 90 + 1 AS STRING) || ' anos' AS age,
  {_pad("k * 131 % 100000", 5)} || '-' || {_pad("k % 1000", 3)} AS cep,
  'c' || CAST(k AS STRING) || '@exemplo.com.br' AS email,
  CASE k % 2 WHEN 0 THEN 'Beatriz Nunes' ELSE 'Carlos E. Teles' END AS doctor,
  'CRM-SP ' || {_pad("k * 17 % 1000000", 6)} AS crm,
  {_pad("k % 90 + 10", 2)} || '.' || {_pad("k * 3 % 1000", 3)} || '.' || {_pad("k * 7 % 1000", 3)} || '-' || CAST(k % 10 AS STRING) AS rg,
  substr(cnpj, 1, 2) || '.' || substr(cnpj, 3, 3) || '.' || substr(cnpj, 6, 3) || '/' || substr(cnpj, 9, 4) || '-' || substr(cnpj, 13, 2) AS cnpj,
  cns, {_pad("k * 7919 % 10000000", 7)} AS record
FROM numbers n"""

#: (text before the value, value, label of the rule or None).
PIECES = [
    ("Paciente: ", "person", "PERSON"), (chr(10) + "CPF: ", "cpf", "BR_CPF"), ("   Tel: ", "phone", "PHONE"), (chr(10) + "Nascimento: ", "born", "DATE"), (" (", "age", "AGE"), (")" + chr(10) + "CEP ", "cep", "ZIPCODE"),
    (" ", "email", "EMAIL"), (chr(10) + "Medico: Dra. ", "doctor", "PERSON"), ("  ", "crm", "CRM"), (chr(10) + "RG ", "rg", "BR_RG"), (" CNPJ ", "cnpj", "BR_CNPJ"), (chr(10) + "Prontuario: ", "record", None), (chr(10) + "Cartao SUS ", "cns", None),
]


def _text(upto: int | None = None) -> str:
    out = ["lead"]
    for before, value, _ in PIECES[: len(PIECES) if upto is None else upto]:
        out += [f"'{before}'", value]
    if upto is not None:
        out.append(f"'{PIECES[upto][0]}'")
    return " || ".join(out)


NOTES_SQL = f"SELECT note_id, {_text()} AS text FROM vals"
#: note_id, start, stop, label, value, valid of each value with a rule.
GOLD_SQL = " UNION ALL ".join(
    f"SELECT note_id, CAST(length({_text(i)}) AS INT) AS char_start, CAST(length({_text(i)} || {value}) AS INT) AS char_end, '{label}' AS label, {value} AS value, {'cpf_ok' if value == 'cpf' else 'true'} AS valid FROM vals"
    for i, (_, value, label) in enumerate(PIECES)
    if label
)


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS k")


def sql_over_keys(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """A query over keys(k), numbers and vals (the notes' values)."""
    keys(spark, sf_dir).createOrReplaceTempView("keys")
    # cached, else the optimizer writes the steps' expressions into each other
    for name, step in STEPS.items():
        df = spark.sql(step).repartition("k")
        (df.cache() if name == "numbers" else df).createOrReplaceTempView(name)
    spark.sql(VALUES_SQL).repartition("note_id").cache().createOrReplaceTempView("vals")
    return spark.sql(query)


def duck(query: str) -> str:
    """The same query as one DuckDB statement over the customer table."""
    steps = ", ".join(f"{name} AS ({step})" for name, step in (STEPS | {"vals": VALUES_SQL}).items())
    return f"WITH keys AS (SELECT c_custkey AS k FROM customer), {steps} {query}"


#: Lines of the mock page: our own wording, one value of each kind.
MOCK_LINES = (
    "UNIDADE MEDICA MODELO", "Paciente: Helena Castro da Rocha", "CPF: 529.982.247-25   RG: 23.456.789-0", "Nascimento: 07/09/1981  Idade: 43 anos", "Tel: (21) 98765-4321 helena@exemplo.org",
    "Endereco: Avenida Central, 900, Bairro Novo", "Medico: Dr. Paulo Neves  CRM-RJ 654321", "Data do exame: 03/04/2024", "Laudo: estruturas de aspecto habitual, sem achados.",
)


def mock_page(spark: SparkSession, width: int = 1240, height: int = 1754) -> DataFrame:
    """Evenly spaced lines of a page: page_id, line_idx, txt, sides, confidence."""
    step = height / (len(MOCK_LINES) + 2)
    rows = [(1, i, t, 80.0, step * (i + 1), min(width - 80.0, 80.0 + 14.0 * len(t)), step * (i + 1) + step * 0.6, 0.99) for i, t in enumerate(MOCK_LINES)]
    return spark.createDataFrame(rows, "page_id int, line_idx int, txt string, x0 double, y0 double, x1 double, y1 double, confidence double")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, text); cached, so that what reads the text does not compute it again."""
    return sql_over_keys(spark, sf_dir, NOTES_SQL).repartition("note_id").cache()
