"""Names: after a field word, and widening a name that was found in part.

A run of name tokens is one regular expression with possessive parts, so that it takes
tokens whole and never gives back a dot or a letter to pass a look-ahead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.text import cut, let, line_end, line_start
from spanveil.labels import PERSON_LABELS
from spanveil.schemas import SPAN, SPANS

# Small words inside names, titles, and words that end a name.
CONNECTIVES = (
    "de", "da", "do", "dos", "das", "e", "del", "di", "du", "van", "von", "der", "la", "le",
)
TITLES = (
    "dr", "dra", "drs", "doutor", "doutora", "sr", "sra", "srta", "prof", "profa", "professor", "professora",
)
STOPWORDS = (
    "crm", "crmv", "cro", "crf", "crbm", "coren", "crefito", "crn", "crp", "cns", "cnes", "rqe", "uf", "sp", "rj", "mg", "rs", "pr", "ba", "pe", "registro", "prontuario",
    "prontuário", "matricula", "matrícula", "idade", "data", "convenio", "convênio", "plano", "carteirinha", "sexo", "telefone", "celular", "email", "endereco", "endereço", "cpf",
    "rg", "guia", "senha", "leito", "quarto", "setor", "especialidade", "exame", "solicitante", "requisitante", "executante", "responsavel", "responsável", "clinica", "clínica",
    "hospital", "laboratorio", "laboratório", "unidade", "operadora", "codigo", "código", "assinatura", "carimbo", "obs", "observacoes", "observações",
)
# Fixed value: words of a form that stand before a person's name.
FIELD = (
    r"\b(?:pacientes?|pac|nome(?:\s+(?:completo|do\s+paciente|da\s+m[aã]e|social))?|m[eé]dic[oa]|doutor[a]?|dr[a]?|solicitante|requisitante|executante|"
    r"respons[aá]vel|profissional|examinador[a]?|benefici[aá]ri[oa]|titular|segurad[oa]|m[aã]e|pai|acompanhante)\b\.?"
)
MOST_TOKENS = 8

_L, _UP = "A-Za-zÀ-ÖØ-öø-ÿ", "A-ZÀ-ÖØ-Þ"
_END = rf"(?![{_L}'])"
_SMALL = [w for w in CONNECTIVES if len(w) > 1]
_LINK = rf"(?:(?iu:{'|'.join(_SMALL)}){_END}\.?+|(?:{'|'.join(w.upper() for w in CONNECTIVES if len(w) == 1)}){_END}\.)"
_STOP = rf"(?!(?iu:{'|'.join(STOPWORDS)}){_END})"
_WORD = rf"(?:[{_UP}][{_L}]++{_END}\.?+|[{_UP}]{_END}\.)"
_NEXT = r"(?![ \t]*+:)"
_TOKEN = rf"(?:{_STOP}(?:{_LINK}|{_WORD}){_NEXT})"
_NAMED = rf"(?:{_STOP}(?!{_LINK}){_WORD}{_NEXT})"
#: At most eight tokens, the last of them no connective.
RUN = rf"(?:{_TOKEN} *+){{0,{MOST_TOKENS - 1}}}{_NAMED}"
_TITLE = rf"(?:(?iu:{'|'.join(TITLES)}){_END}\.?+[ \t.]*+)*+"
_GAP = r"[ \t:\-]*+(?:\n[ \t:\-]*+)?+"
LABELLED = rf"(?iuU:{FIELD})(?=({_GAP}{_TITLE})({RUN}))"

# Backwards a token is all letters, apostrophes and dots before the place.
_B = r"(?<![\p{L}'.])"
_BACK_STOP = rf"(?!(?iu:{'|'.join(STOPWORDS + TITLES)})\.*+(?![\p{{L}}'.]))"
_BACK_LINK = rf"(?:(?iu:{'|'.join(_SMALL)})\.*+|(?:{'|'.join(w.upper() for w in CONNECTIVES if len(w) == 1)})\.++)(?![\p{{L}}'.])"
_BACK_WORD = r"(?:\p{Lu}\p{L}++\.*+|\p{Lu}\.++)(?![\p{L}'.])"
_BACK_TOKEN = rf"{_B}{_BACK_STOP}(?:{_BACK_LINK}|{_BACK_WORD})"
_BACK_NAMED = rf"{_B}{_BACK_STOP}(?!{_BACK_LINK}){_BACK_WORD}"
BACK_RUN = rf"{_BACK_NAMED}(?: ++{_BACK_TOKEN}){{0,{MOST_TOKENS - 1}}} *+$"


def labelled_names(text: Column) -> Column:
    """PERSON spans after field words; a title before the name stays outside; one line break at most between word and name."""
    between = F.split(text, LABELLED, -1)
    word, gap, run = (F.regexp_extract_all(text, F.lit(LABELLED), F.lit(i)) for i in range(3))
    rows = F.zip_with(F.zip_with(F.slice(between, 1, F.size(word)), word, lambda b, w: (F.length(b) + F.length(w)).cast("int")), F.arrays_zip(gap.alias("gap"), run.alias("run")), lambda n, g: F.struct(n.alias("n"), g["gap"].alias("gap"), g["run"].alias("run")))
    walked = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,txt:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["n"]).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["n"] + F.length(x["gap"])).cast("int").alias("start"), x["run"].alias("txt")))).alias("out")
        ),
        lambda acc: acc["out"],
    )
    real = F.array_distinct(F.filter(walked, lambda x: F.regexp_like(x["txt"], F.lit(rf"[{_L}']{{2}}"))))
    span = lambda x: F.struct(
        x["start"].alias("start"), (x["start"] + F.length(x["txt"])).cast("int").alias("end"), F.lit("PERSON").alias("label"), x["txt"].alias("txt"), F.lit(0.94).alias("score"),
        F.lit("regex").alias("origin"), F.lit(False).alias("validated"), F.lit(False).alias("strong"),
    )
    return F.when(F.size(word) > 0, F.transform(real, span)).otherwise(F.array().cast(SPANS)).cast(SPANS)


def run_forward(text: Column, start: Column, limit: Column) -> Column:
    """End of the name run that starts here, or start."""
    ahead = F.regexp_extract(cut(text, start, limit), rf"^( *+{RUN})", 1)
    return start + F.length(ahead)


def run_backward(text: Column, end: Column, limit: Column) -> Column:
    """Start of the name run that ends here, or end."""
    return end - F.length(F.regexp_extract(cut(text, limit, end), BACK_RUN, 0))


def expand(text: Column, e: Column) -> Column:
    """A name span with the rest of the name around it on its line; others and spans of several lines stay."""
    bounds = F.struct(line_start(text, e["start"]).alias("low"), line_end(text, e["start"]).alias("high"))
    run = lambda b: F.struct(
        F.least(run_backward(text, e["start"], b["low"]), e["start"]).alias("a"), F.greatest(run_forward(text, e["end"], b["high"]), e["end"]).alias("b"), b["high"].alias("high")
    )

    def wide(r: Column) -> Column:
        whole = cut(text, r["a"], r["b"])
        start = r["a"] + F.length(whole) - F.length(F.ltrim(whole, F.lit(" \t")))
        end = r["b"] - F.length(whole) + F.length(F.rtrim(whole, F.lit(" \t")))
        made = F.struct(
            start.cast("int").alias("start"), end.cast("int").alias("end"), e["label"].alias("label"), F.btrim(whole, F.lit(" \t")).alias("txt"), e["score"].alias("score"),
            e["origin"].alias("origin"), e["validated"].alias("validated"), e["strong"].alias("strong"),
        ).cast(SPAN)
        return F.when(e["end"] <= r["high"], made)

    return F.coalesce(F.when(F.upper(e["label"]).isin(*PERSON_LABELS), let(let(bounds, run), wide)), e)
