"""What a number is, from the words around it; in doubt it is hidden."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import checks
from spanveil.functions.text import core, digit_count, let, normal_context
from spanveil.schemas import SPAN

# Words that name an identifier, in order of preference at equal distance.
IDENTIFIERS = (
    (("prontuario", "pront", "registro hospitalar", "mrn"), "MEDICAL_RECORD"),
    (("atendimento", "atend", "boletim"), "MEDICAL_RECORD"),
    (("guia",), "TISS_GUIDE"),
    (("senha", "autorizacao"), "TISS_AUTH"),
    (("matricula", "carteirinha", "carteira", "cartao", "beneficiario", "convenio", "unimed", "bradesco", "amil", "sulamerica", "sul america", "cassi", "ipasgo", "hapvida"), "INSURANCE_ID"),
    (("cns", "cartao sus", "cartao nacional de saude"), "CNS"),
    (("cnes",), "CNES"),
    (("rqe",), "RQE"),
    (("crm", "cfm"), "CRM"),
    (("coren",), "COREN"),
    (("crbm", "crf", "cro"), "ID"),
    (("registro", "protocolo", "pedido", "ordem de servico", "codigo"), "ID"),
)
# Words that name a measure; up to four letters they must stand alone.
MEASURES = (
    "dbp", "ccn", "cc", "ca", "cf", "cn", "ila", "bcf", "fc", "fr", "pa", "spo2", "sat", "peso", "altura", "comprimento", "diametro", "espessura", "volume", "vol", "medida",
    "area", "imc", "percentil", "grau", "graus", "ig", "idade gestacional", "hb", "ht", "hto", "vcm", "hcm", "chcm", "rdw", "dose", "dosagem", "valor", "qtde", "quantidade",
    "frequencia", "pressao", "temperatura", "saturacao", "indice",
)
# Fixed value: units that may follow.
UNIT = (
    r"(?iuU)^[\s.:,]{0,3}(?:mm3|cm3|mm2|cm2|mmhg|mcg|kcal|bpm|rpm|mg/dl|g/dl|ng/ml|u/l|ui|ml|dl|mg|kg|ug|fl|pg|hz|db|cm|mm|graus?|semanas?|sem\b|"
    r"dias?|min|seg|hs?\b|x\b|%|°c|oc\b|g\b|l\b|m\b|s\b)"
)
CONTEXT_LABELS = ("NUMERO", "MEDICAL_RECORD", "TISS_GUIDE", "TISS_AUTH", "INSURANCE_ID", "CNS", "CNES", "RQE", "COREN")
BACK, AHEAD = 40, 10


def left_window(text: Column, start: Column) -> Column:
    """Up to 40 characters before, across one line break at most."""
    low = F.greatest(F.lit(0), start - BACK)
    return F.substring_index(F.substring(text, low + 1, start - low), "\n", -2)


def right_window(text: Column, end: Column) -> Column:
    """Up to 10 characters after, on the same line."""
    return F.substring_index(F.substring(text, end + 1, F.lit(AHEAD)), "\n", 1)


def _nearest(window: Column, keys: list[str]) -> Column:
    """Least number of characters after any of these keys."""
    back = F.reverse(window)
    at = F.transform(F.array(*[F.lit(k[::-1]) for k in keys]), lambda k: F.nullif(F.position(k, back), F.lit(0)) - 1)
    return F.array_min(at)


def nearest_identifier(window: Column) -> Column:
    """struct(distance, order, label) of the nearest identifier word, null without one."""
    back = F.reverse(window)
    table = [F.struct(F.lit(k[::-1]).alias("k"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, (k, label) in enumerate((k, label) for keys, label in IDENTIFIERS for k in keys)]
    found = F.transform(F.array(*table), lambda t: F.when(F.position(t["k"], back) > 0, F.struct((F.position(t["k"], back) - 1).alias("d"), t["i"].alias("i"), t["label"].alias("label"))))
    return F.array_min(found)


def nearest_measure(window: Column) -> Column:
    short = "|".join(k for k in MEASURES if len(k) <= 4)
    pattern = rf"(?sU)^.*\b(?:{short})\b(.*)$"
    alone = F.when(F.regexp_like(window, F.lit(pattern)), F.length(F.regexp_extract(window, pattern, 1)))
    return F.least(alone, _nearest(window, [k for k in MEASURES if len(k) > 4]))


def classify(text: Column, e: Column) -> Column:
    """The span with its label and origin ``numeric``, or null where it is a measure or too short to matter."""
    raw = F.struct(core(e["txt"]).alias("value"), left_window(text, e["start"]).alias("left"), right_window(text, e["end"]).alias("right"))

    def looked_up(r: Column) -> Column:
        return let(normal_context(r["left"]), lambda left: let(F.struct(nearest_identifier(left).alias("near"), nearest_measure(left).alias("measure")), lambda k: _decided(text, e, r, k["near"], k["measure"])))

    return let(raw, looked_up)


def _decided(text: Column, e: Column, raw: Column, near: Column, measure: Column) -> Column:
    value, left, right = raw["value"], raw["left"], raw["right"]
    years = F.regexp_like(right, F.lit(r"(?iuU)^\s{0,2}anos?\b"))
    identified = near.isNotNull() & (measure.isNull() | (near["d"] <= measure))
    before = F.when(e["start"] > 0, F.substring(text, e["start"], F.lit(1))).otherwise(F.lit(""))
    clinical = (
        F.regexp_like(right, F.lit(UNIT)) | measure.isNotNull() | F.regexp_like(value, F.lit(r"(?U)\d,\d")) | F.regexp_like(left, F.lit(r"(?iuU)x\s{0,2}$"))
        | F.regexp_like(value, F.lit(r"(?U)^\d{1,2}:\d{2}$")) | (F.regexp_like(before, F.lit(r"\p{L}")) & F.regexp_like(value, F.lit(r"(?U)^\d{2}(\.\d)?$")))
    )
    date = F.regexp_like(value, F.lit(r"(?U)^\d{1,2}/\d{1,2}(/\d{2,4})?$|^\d{1,2}/\d{4}$"))
    label = F.when(years, "AGE").when(identified, near["label"]).when(clinical, None).when(date, "DATE").when(digit_count(value) >= 4, "NUMERO")

    def made(name: Column) -> Column:
        validated = F.when(identified & ~years, (name == "CNS") & checks.cns_valid(value)).otherwise(e["validated"])
        out = F.struct(e["start"].alias("start"), e["end"].alias("end"), name.alias("label"), e["txt"].alias("txt"), e["score"].alias("score"), F.lit("numeric").alias("origin"), validated.alias("validated"), e["strong"].alias("strong"))
        return F.when(name.isNotNull(), out.cast(SPAN))

    return let(label, made)
