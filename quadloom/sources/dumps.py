"""Entity dumps: one JSON entity a line, in a JSON array or not, to quads.

Everything is parsed by the JVM in one pass without a shuffle; a line that is
no entity is skipped. Labels, descriptions and aliases can be limited to some
languages (None: all); qualifiers can be left out. Lexemes lack some of the maps,
which then give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T

_SNAK = "struct<snaktype:string,property:string,datatype:string,datavalue:struct<value:string,type:string>>"
_TEXT = "struct<language:string,value:string>"
ENTITY = f"""id string, type string, labels map<string,{_TEXT}>, descriptions map<string,{_TEXT}>, aliases map<string,array<{_TEXT}>>,
claims map<string,array<struct<mainsnak:{_SNAK},type:string,id:string,rank:string,qualifiers:map<string,array<{_SNAK}>>>>>"""

_TEXTS = {"string": "string", "external-id": "identifier", "url": "iri", "commonsMedia": "media", "geo-shape": "geoshape", "tabular-data": "tabular", "math": "math", "musical-notation": "music"}
_ENTITIES = ("wikibase-item", "wikibase-property", "wikibase-lexeme", "wikibase-sense", "wikibase-form")
_CLOCK = r"^([+-]?\d+)-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)Z$"


def once(x: Column) -> Column:
    """x, worked out one time a row: as its value counts as not repeatable, the optimizer doesn't copy it into filters and projections above.

    The lambda keeps its projection out of the stage's generated code, which would be one method that is too long for the JVM to compile.
    """
    return F.when(F.exists(F.array(F.spark_partition_id()), lambda i: i >= 0), x)


def entity(name: Column) -> Column:
    """Q, P or L and a number as a term; anything else null. Forms and senses count as their lexeme."""
    number = F.regexp_extract(name, r"^[QPL](\d+)(?:-[FS]\d+)?$", 1).try_cast("bigint")
    kind = F.when(name.startswith("Q"), 1).when(name.startswith("P"), 2).when(name.startswith("L"), 3)
    return F.when(number.isNotNull(), T.make_term(kind, i=number))


def _cases(on: Column, *cases: tuple[list[str], Column]) -> Column:
    """The value of the case that has on; null if none has."""
    out = F.when(on.isin(cases[0][0]), cases[0][1])
    for names, value in cases[1:]:
        out = out.when(on.isin(names), value)
    return out


def snak_terms(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns of snaks turned into their values; null for an unknown or missing value and for an unknown datatype.

    Three steps, so that each field of a value is looked up once: its fields, what they are, the term.
    """
    items, texts = list(_ENTITIES), list(_TEXTS)
    kind, raw, at = (lambda c: F.col(f"{c}.kind")), (lambda c: F.col(f"{c}.raw")), (lambda c, n: F.col(f"{c}.f{n}"))

    def fields(c: str) -> Column:
        kind, raw = F.col(c)["datatype"], F.col(c)["datavalue"]["value"]
        field = lambda path: F.get_json_object(raw, f"$.{path}")
        first = _cases(kind, (items, field("id")), (["quantity"], field("amount")), (["time"], field("time")), (["monolingualtext"], field("text")), (["globe-coordinate"], field("latitude")))
        second = _cases(kind, (["quantity"], field("unit")), (["time"], field("calendarmodel")), (["monolingualtext"], field("language")), (["globe-coordinate"], field("globe")))
        return F.struct(kind.alias("kind"), raw.alias("raw"), first.alias("f1"), second.alias("f2"), F.when(kind.isin("time", "globe-coordinate"), field("precision")).alias("f3"), F.when(kind == "globe-coordinate", field("longitude")).alias("f4"))

    def meant(c: str) -> Column:
        number = F.regexp_extract(F.coalesce(at(c, 1), F.lit("")), r"^[QPL](\d+)(?:-[FS]\d+)?$", 1).try_cast("bigint")
        tail = F.regexp_extract(at(c, 2), r"(Q\d+)$", 1)
        second = _cases(kind(c), (["quantity", "time", "globe-coordinate"], tail), (["monolingualtext"], F.lower(at(c, 2))))
        return F.struct(kind(c).alias("kind"), raw(c).alias("raw"), at(c, 1).alias("f1"), second.alias("f2"), at(c, 3).alias("f3"), at(c, 4).alias("f4"), F.when(kind(c).isin(items), number).alias("number"), F.when(kind(c) == "time", at(c, 1).rlike(_CLOCK)).alias("clock"))

    def term(c: str) -> Column:
        number, time = F.col(f"{c}.number"), at(c, 1)
        letter = F.when(time.startswith("Q"), 1).when(time.startswith("P"), 2).when(time.startswith("L"), 3)
        code = F.when(number.isNotNull(), letter).when(kind(c) == "monolingualtext", 5).when(kind(c) == "quantity", 12).when(F.col(f"{c}.clock"), F.when(at(c, 3).try_cast("int") > 11, 13).otherwise(14)).when(kind(c) == "globe-coordinate", 15)
        for datatype, name in _TEXTS.items():
            code = code.when(kind(c) == datatype, T.CODE[name])
        # The places of a time are counted from its end, as years have any length.
        part = lambda start, length: F.substring(time, start, length).try_cast("bigint")
        moment = T.clock(F.substring(time, F.lit(1), F.length(time) - 16).try_cast("bigint"), *(part(n, 2) for n in (-15, -12, -9, -6, -3)))
        i = F.when(F.col(f"{c}.clock"), moment).otherwise(number)
        d = _cases(kind(c), (["quantity"], time), (["time", "globe-coordinate"], at(c, 3))).try_cast("double")
        s = _cases(kind(c), (texts, raw(c)), (["quantity", "monolingualtext"], time), (["time"], F.regexp_replace(time, r"^\+", "")), (["globe-coordinate"], F.concat(F.lit("Point("), at(c, 4), F.lit(" "), time, F.lit(")"))))
        l = F.when(kind(c) == "quantity", F.coalesce(F.nullif(at(c, 2), F.lit("")), F.lit("1"))).otherwise(at(c, 2))  # noqa: E741
        known = F.when(kind(c).isin(items), number.isNotNull()).when(kind(c) == "time", F.col(f"{c}.clock")).otherwise(kind(c).isin([*texts, "monolingualtext", "quantity", "globe-coordinate"]))
        return F.when(raw(c).isNotNull() & known, T.make_term(code, i=i, d=d, s=s, l=l))

    for step in (fields, meant, term):
        df = df.select(*(once(step(c)).alias(c) if c in columns else F.col(c) for c in df.columns))
    return df


def entities(lines: DataFrame) -> DataFrame:
    """Parsed entities from lines (column value): brackets, blank and malformed lines are skipped, a trailing comma is cut."""
    value = F.col("line")
    text = F.when(value.endswith(","), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    parsed = lines.select(once(F.trim("value")).alias("line")).where(F.length("line") > 1).select(once(F.from_json(text, ENTITY)).alias("e"))
    return parsed.where("e.id is not null").select("e.*")


_FACT = f"struct<what:string,lang:string,text:string,id:string,rank:string,snak:{_SNAK}>"


def quads(items: DataFrame, languages: list[str] | None = None, qualifiers: bool = True, keys: set[str] | None = None) -> DataFrame:
    """Quads of parsed entities, for batch and streaming frames alike; keys: of these predicates (pkey) only.

    All facts of an entity are put into one array, which is exploded once.
    """

    def fact(what: str, lang: Column | None = None, text: Column | None = None, claim: Column | None = None, snak: Column | None = None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(F.lit(what).alias("what"), (null if lang is None else lang).alias("lang"), (null if text is None else text).alias("text"), (null if claim is None else claim["id"]).alias("id"), (null if claim is None else claim["rank"]).alias("rank"), (F.lit(None).cast(_SNAK) if snak is None else snak).alias("snak"))

    def some(facts: Column) -> Column:
        return F.coalesce(facts, F.lit([]).cast(f"array<{_FACT}>"))

    def texts(column: str) -> Column:
        entries = F.map_entries(column)
        return entries if languages is None else F.filter(entries, lambda e: e["key"].isin(languages) if languages else F.lit(False))

    def claim(c: Column) -> Column:
        main = F.array(fact("claim", claim=c, snak=c["mainsnak"]))
        if not qualifiers:
            return main
        return F.concat(main, some(F.transform(F.flatten(F.map_values(c["qualifiers"])), lambda q: fact("qualifier", claim=c, snak=q))))

    def single(column: str, what: str) -> Column:
        return some(F.transform(texts(column), lambda e: fact(what, e["key"], e["value"]["value"])))

    facts = [single("labels", "label"), single("descriptions", "description")]
    facts.append(some(F.flatten(F.transform(texts("aliases"), lambda e: F.transform(e["value"], lambda x: fact("alias", e["key"], x["value"]))))))
    facts.append(some(F.flatten(F.transform(F.flatten(F.map_values("claims")), claim))))
    rows = items.select(once(entity(F.col("id"))).alias("e"), once(F.concat(*facts)).alias("facts")).select("e", F.explode("facts").alias("f"))
    what, snak = F.col("f.what"), F.col("f.snak")
    main, side = what == "claim", what == "qualifier"
    statement = F.replace(F.col("f.id"), F.lit("$"), F.lit("-"))
    pkey = F.when(main | side, snak["property"]).otherwise(what)
    if keys is not None:
        rows = rows.where(pkey.isin(sorted(keys)))
    number = F.regexp_extract(snak["property"], r"^P(\d+)$", 1).try_cast("bigint")
    named = F.lit(None).cast(T.TERM)
    for name in ("label", "description", "alias"):
        named = F.when(what == name, T.make_term(T.CODE[name], s=F.lower("f.lang"))).otherwise(named)
    claims = rows.select(
        F.when(side, T.make_term(T.CODE["stmt"], s=statement)).otherwise(F.col("e")).alias("s"),
        once(F.when(main | side, T.make_term(2, i=number)).otherwise(named)).alias("p"),
        F.col("f.text").alias("text"),
        snak.alias("o"),
        F.when(main, statement).alias("id"),
        main.alias("claim"),
        F.when(main, F.col("f.rank")).alias("rank"),
        pkey.alias("pkey"),
    )
    o = F.when(F.col("pkey").isin("label", "description", "alias"), T.make_term(4, s=F.col("text"))).otherwise(F.col("o"))
    out = snak_terms(claims, "o").select("s", "p", o.alias("o"), "id", "claim", "rank", "pkey")
    # An unnamed edge is known by its content, the same on every run.
    return out.withColumn("id", F.coalesce("id", F.when(~F.col("claim"), F.md5(F.to_json(F.struct("s", "p", "o"))))))


def statements(items: DataFrame) -> DataFrame:
    """Claims of parsed entities, one a row: s TERM, id STRING, snak, qualifiers (an array of snaks)."""
    rows = items.select(once(entity(F.col("id"))).alias("s"), once(F.flatten(F.map_values("claims"))).alias("all")).select("s", F.explode("all").alias("c"))
    return rows.select("s", F.replace(F.col("c.id"), F.lit("$"), F.lit("-")).alias("id"), F.col("c.mainsnak").alias("snak"), F.flatten(F.map_values("c.qualifiers")).alias("qualifiers"))


def read(spark: SparkSession, path: str, languages: list[str] | None = None, qualifiers: bool = True) -> DataFrame:
    """Quads of a dump file or folder (plain or compressed text)."""
    return quads(entities(spark.read.text(path)), languages, qualifiers)
