"""Country names and codes as they occur in catalogues, to two-letter codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of each country, without accents, in lower case.
NAMES = {
    "AR": "argentina",
    "AT": "austria|osterreich",
    "AU": "australia",
    "BE": "belgium|belgique",
    "BR": "brazil|brasil",
    "CA": "canada",
    "CH": "switzerland|schweiz|suisse",
    "CL": "chile",
    "CN": "china|peoples republic of china|pr china",
    "CO": "colombia",
    "CZ": "czechia|czech republic",
    "DE": "germany|deutschland",
    "DK": "denmark",
    "EG": "egypt",
    "ES": "spain|espana",
    "FI": "finland|suomi",
    "FR": "france",
    "GB": "united kingdom|uk|great britain|england",
    "GR": "greece",
    "HU": "hungary|magyarorszag",
    "ID": "indonesia",
    "IE": "ireland",
    "IN": "india",
    "IR": "iran|iran islamic republic of",
    "IT": "italy|italia",
    "JP": "japan",
    "KR": "south korea|korea republic of|republic of korea|korea",
    "MX": "mexico",
    "MY": "malaysia",
    "NL": "netherlands|the netherlands|holland",
    "NO": "norway|norge",
    "PL": "poland|polska",
    "PT": "portugal",
    "RO": "romania",
    "RU": "russia|russian federation",
    "SE": "sweden|sverige",
    "TR": "turkey|turkiye",
    "UA": "ukraine",
    "US": "united states|united states of america|usa",
    "ZA": "south africa",
}


def country_code(value: Column) -> Column:
    """The two-letter code of a country's name or code; other names fold to themselves."""
    folded = F.lower(F.translate(F.trim(value), "üÜöÖñÑéÉèÈáÁíÍóÓçÇ", "uUoOnNeEeEaAiIoOcC"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(folded, r"[.'’]", ""), r"[^a-z]+", " "))
    table = F.create_map(*(F.lit(x) for code, names in NAMES.items() for name in names.split("|") for x in (name, code)))
    # A lambda, so that the folding is done once for all its uses.
    coded = lambda x: F.coalesce(F.try_element_at(table, x), F.when(F.length(x) == 2, F.upper(x)).otherwise(x))
    return F.get(F.transform(F.array(plain), coded), F.lit(0))
