"""Countries that the site knows, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: code, slug, language, region; and further languages by country ---
COUNTRIES = """
IN india hi south-asia
PK pakistan ur south-asia
BD bangladesh bn south-asia
LK srilanka si south-asia
NP nepal ne south-asia
US us en north-america
CA canada en north-america
MX mexico es north-america
GB uk en europe
DE germany de europe
FR france fr europe
ES spain es europe
IT italy it europe
NL netherlands nl europe
RU russia ru europe
AE uae ar middle-east
SA saudi-arabia ar middle-east
QA qatar ar middle-east
TR turkey tr middle-east
EG egypt ar middle-east
CN china zh east-asia
JP japan ja east-asia
KR south-korea ko east-asia
SG singapore en southeast-asia
MY malaysia ms southeast-asia
ID indonesia id southeast-asia
AU australia en oceania
NZ newzealand en oceania
ZA south-africa en africa
NG nigeria en africa
KE kenya en africa
BR brazil pt south-america
AR argentina es south-america
CO colombia es south-america
"""
EXTRA_LANGUAGES = {
    "IN": ["hi", "mr", "bn", "te", "ta", "gu", "kn", "pa", "ur"], "CA": ["fr"], "PK": ["ur"], "BD": ["bn"], "AE": ["ar"], "SA": ["ar"], "QA": ["ar"], "EG": ["ar"],
    "MX": ["es"], "ES": ["es"], "AR": ["es"], "CO": ["es"], "BR": ["pt"], "FR": ["fr"], "DE": ["de"], "RU": ["ru"], "CN": ["zh"], "JP": ["ja"], "KR": ["ko"],
    "ID": ["id"], "TR": ["tr"], "IT": ["it"],
}
# --- end of fixed values ---

ROWS = [tuple(line.split()) for line in COUNTRIES.split("\n") if line]


def countries(spark: SparkSession) -> DataFrame:
    """place (in the site's order), code, slug, language, region, extra."""
    rows = [(i, *row, EXTRA_LANGUAGES.get(row[0])) for i, row in enumerate(ROWS)]
    return spark.createDataFrame(rows, "place int, code string, slug string, language string, region string, extra array<string>")


def sql_values() -> str:
    """The same as SQL rows."""
    each = [f"({i}, " + ", ".join(f"'{x}'" for x in row) + f", {EXTRA_LANGUAGES.get(row[0]) or '[]::VARCHAR[]'})" for i, row in enumerate(ROWS)]
    return f"(VALUES {', '.join(each)}) c(place, code, slug, language, region, extra)"
