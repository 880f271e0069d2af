"""Fixed reference tables of the country: states, regions, populations, name spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# State code, state name, region, population of the 2022 census.
STATES = [
    ("AC", "Acre", "Norte", 830018),
    ("AL", "Alagoas", "Nordeste", 3127683),
    ("AP", "Amapá", "Norte", 733759),
    ("AM", "Amazonas", "Norte", 3941613),
    ("BA", "Bahia", "Nordeste", 14141626),
    ("CE", "Ceará", "Nordeste", 8794957),
    ("DF", "Distrito Federal", "Centro-Oeste", 2817381),
    ("ES", "Espírito Santo", "Sudeste", 3833712),
    ("GO", "Goiás", "Centro-Oeste", 7056495),
    ("MA", "Maranhão", "Nordeste", 6776699),
    ("MT", "Mato Grosso", "Centro-Oeste", 3658649),
    ("MS", "Mato Grosso do Sul", "Centro-Oeste", 2757013),
    ("MG", "Minas Gerais", "Sudeste", 20539989),
    ("PA", "Pará", "Norte", 8120131),
    ("PB", "Paraíba", "Nordeste", 3974687),
    ("PR", "Paraná", "Sul", 11444380),
    ("PE", "Pernambuco", "Nordeste", 9058931),
    ("PI", "Piauí", "Nordeste", 3271199),
    ("RJ", "Rio de Janeiro", "Sudeste", 16055174),
    ("RN", "Rio Grande do Norte", "Nordeste", 3302729),
    ("RS", "Rio Grande do Sul", "Sul", 10882965),
    ("RO", "Rondônia", "Norte", 1581196),
    ("RR", "Roraima", "Norte", 636707),
    ("SC", "Santa Catarina", "Sul", 7610361),
    ("SP", "São Paulo", "Sudeste", 44411238),
    ("SE", "Sergipe", "Nordeste", 2210004),
    ("TO", "Tocantins", "Norte", 1511460),
]

# City names as the files write them, and the official spelling.
CITY_SPELLINGS = {
    "CEILANDIA": "BRASILIA",
    "SAMAMBAIA": "BRASILIA",
    "LAGO NORTE": "BRASILIA",
    "LAGO SUL": "BRASILIA",
    "NUCLEO BANDEIRANTE": "BRASILIA",
    "AUGUSTO SEVERO": "CAMPO GRANDE",
    "JANUARIO CICCO": "BOA SAUDE",
    "MOJI MIRIM": "MOGI MIRIM",
    "PARATI": "PARATY",
    "POXOREO": "POXOREU",
    "BRASOPOLIS": "BRAZOPOLIS",
    "IGUARACI": "IGUARACY",
    "BELEM DE SAO FRANCISCO": "BELEM DO SAO FRANCISCO",
    "LAGOA DO ITAENGA": "LAGOA DE ITAENGA",
    "SAO LUIS DO PARAITINGA": "SAO LUIZ DO PARAITINGA",
    "SAO VALERIO DA NATIVIDADE": "SAO VALERIO",
    "SERIDO": "CARNAUBA DOS DANTAS",
    "TRAJANO DE MORAIS": "TRAJANO DE MORAES",
}

REGION_OF = {code: region for code, _, region, _ in STATES}
CODE_OF = {name: code for code, name, _, _ in STATES}


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATES, "uf string, nome string, regiao string, populacao bigint")


def population_by_state(areas: DataFrame, name: str, people: str) -> DataFrame:
    """Population per state code from a table of areas; areas that are no state drop out."""
    totals = areas.groupBy(F.col(name).alias("nome")).agg(F.sum(people).alias("populacao"))
    codes = states(areas.sparkSession).select("uf", "nome")
    return totals.join(codes, "nome").select("uf", "populacao")
