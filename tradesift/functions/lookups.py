"""Lookup tables and lookups on them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.functions.text import alias_key_of

# Country table. ISO code, canonical name, further names separated by "|".
COUNTRY_TABLE = """
US United States|USA|US|United States of America|America|U S A
GB United Kingdom|UK|Great Britain|Britain|England|Scotland|Wales|Northern Ireland
AE United Arab Emirates|UAE|Emirates
AF Afghanistan
AL Albania
DZ Algeria
AO Angola
AR Argentina
AM Armenia
AU Australia
AT Austria
AZ Azerbaijan
BS Bahamas
BH Bahrain
BD Bangladesh
BB Barbados
BY Belarus
BE Belgium
BZ Belize
BJ Benin
BT Bhutan
BO Bolivia
BA Bosnia and Herzegovina|Bosnia
BW Botswana
BR Brazil|Brasil
BN Brunei|Brunei Darussalam
BG Bulgaria
BF Burkina Faso
BI Burundi
KH Cambodia
CM Cameroon
CA Canada
CV Cape Verde|Cabo Verde
CL Chile
CN China|People's Republic of China|PRC
CO Colombia
CD Democratic Republic of the Congo|DR Congo|DRC|Congo-Kinshasa|Congo Kinshasa
CG Republic of the Congo|Congo-Brazzaville|Congo Brazzaville
CR Costa Rica
CI Côte d'Ivoire|Ivory Coast|Cote d'Ivoire
HR Croatia
CU Cuba
CY Cyprus
CZ Czechia|Czech Republic
DK Denmark
DJ Djibouti
DO Dominican Republic
EC Ecuador
EG Egypt
SV El Salvador
GQ Equatorial Guinea
ER Eritrea
EE Estonia
SZ Eswatini|Swaziland
ET Ethiopia
FJ Fiji
FI Finland
FR France
GA Gabon
GM Gambia
GE Georgia
DE Germany|Deutschland
GH Ghana
GR Greece
GT Guatemala
GN Guinea
GW Guinea-Bissau|Guinea Bissau
GY Guyana
HT Haiti
HN Honduras
HK Hong Kong
HU Hungary
IS Iceland
IN India
ID Indonesia
IR Iran
IQ Iraq
IE Ireland|Republic of Ireland
IL Israel
IT Italy
JM Jamaica
JP Japan
JO Jordan
KZ Kazakhstan
KE Kenya
KW Kuwait
KG Kyrgyzstan
LA Laos
LV Latvia
LB Lebanon
LS Lesotho
LR Liberia
LY Libya
LT Lithuania
LU Luxembourg
MO Macau|Macao
MG Madagascar
MW Malawi
MY Malaysia
MV Maldives
ML Mali
MT Malta
MR Mauritania
MU Mauritius
MX Mexico
MD Moldova
MN Mongolia
ME Montenegro
MA Morocco
MZ Mozambique
MM Myanmar|Burma
NA Namibia
NP Nepal
NL Netherlands|Holland
NZ New Zealand
NI Nicaragua
NE Niger
NG Nigeria
KP North Korea|Democratic People's Republic of Korea|DPRK
MK North Macedonia|Macedonia
NO Norway
OM Oman
PK Pakistan
PS Palestine
PA Panama
PG Papua New Guinea
PY Paraguay
PE Peru
PH Philippines
PL Poland
PT Portugal
PR Puerto Rico
QA Qatar
RO Romania
RU Russia|Russian Federation
RW Rwanda
SA Saudi Arabia|KSA|Kingdom of Saudi Arabia
SN Senegal
RS Serbia
SC Seychelles
SL Sierra Leone
SG Singapore
SK Slovakia
SI Slovenia
SO Somalia
ZA South Africa|RSA
KR South Korea|Republic of Korea
SS South Sudan
ES Spain
LK Sri Lanka
SD Sudan
SR Suriname
SE Sweden
CH Switzerland
SY Syria
TW Taiwan
TJ Tajikistan
TZ Tanzania
TH Thailand
TG Togo
TT Trinidad and Tobago|Trinidad & Tobago
TN Tunisia
TR Turkey|Türkiye|Turkiye
TM Turkmenistan
UG Uganda
UA Ukraine
UY Uruguay
UZ Uzbekistan
VE Venezuela
VN Vietnam|Viet Nam
YE Yemen
ZM Zambia
ZW Zimbabwe
"""

# Packaging units, canonical name then accepted spellings.
UNIT_TABLE = """
strip: strip strips
box: box boxes bx
vial: vial vials
piece: piece pieces pc pcs nos no number numbers
bottle: bottle bottles btl
tablet: tablet tablets tab tabs
capsule: capsule capsules cap caps
pack: pack packs packet packets pkt
unit: unit units
ampoule: ampoule ampoules ampule ampules amp amps
tube: tube tubes
sachet: sachet sachets
kit: kit kits
carton: carton cartons
blister: blister blisters
pen: pen pens
jar: jar jars
bag: bag bags
gram: gram grams g gm gms gr
kg: kg kgs kilogram kilograms kilo kilos
mg: mg milligram milligrams
ml: ml millilitre millilitres milliliter milliliters
litre: l ltr ltrs litre litres liter liters
ton: ton tons tonne tonnes mt
"""

# Strength units, canonical name then compact spellings, separated by "|".
STRENGTH_UNIT_TABLE = """
mg: mg|milligram|milligrams
mcg: mcg|ug|microgram|micrograms
g: g|gm|gram|grams
kg: kg
ml: ml
l: l
iu: iu|i.u.
unit: units|unit|u
%: %
% w/w: %w/w
% w/v: %w/v
% v/v: %v/v
meq: meq
mmol: mmol
mcl: mcl
"""

# Dosage forms, canonical name then accepted spellings, separated by "|".
DOSAGE_FORM_TABLE = """
tablet: tablet|tablets|tab|tabs
capsule: capsule|capsules|cap|caps
softgel: softgel|softgels|soft gel|soft gels|soft gelatin capsule
injection: injection|injections|injectable|injectables
cream: cream|creams
ointment: ointment|ointments
gel: gel|gels
lotion: lotion|lotions
spray: spray|sprays|nasal spray
syrup: syrup|syrups
suspension: suspension|suspensions
solution: solution|solutions
drops: drop|drops
powder: powder|powders
granules: granule|granules
sachet: sachet|sachets
patch: patch|patches
inhaler: inhaler|inhalers
suppository: suppository|suppositories
liquid: liquid|liquids
oil: oil|oils
lozenge: lozenge|lozenges
shampoo: shampoo|shampoos
"""


def _spellings(table: str, separator: str | None) -> dict[str, str]:
    """Spelling to canonical name."""
    index: dict[str, str] = {}
    for line in table.strip().splitlines():
        canonical, _, spellings = line.partition(": ")
        index.update((spelling, canonical) for spelling in spellings.split(separator))
    return index


UNITS = _spellings(UNIT_TABLE, None)
STRENGTH_UNITS = _spellings(STRENGTH_UNIT_TABLE, "|")
DOSAGE_FORMS = _spellings(DOSAGE_FORM_TABLE, "|")


def country_rows() -> list[tuple[str, str, str, str]]:
    """(alias key, code, name, alias key of the name); an alias of two countries is an error."""
    rows: dict[str, tuple[str, str, str, str]] = {}
    for line in COUNTRY_TABLE.strip().splitlines():
        code, _, spellings = line.partition(" ")
        names = spellings.split("|")
        for spelling in names:
            key = alias_key_of(spelling)
            if key in rows and rows[key][1] != code:
                raise ValueError(f"{spelling!r} names two countries")
            rows[key] = (key, code, names[0], alias_key_of(names[0]))
    return list(rows.values())


def country_aliases(spark: SparkSession) -> DataFrame:
    """A few hundred fixed rows: safe to broadcast whatever the lead table holds."""
    keys, codes, names, name_keys = zip(*country_rows())
    table = pa.table(
        {"alias": keys, "code": codes, "country_name": names, "country_name_key": name_keys}
    )
    return spark.createDataFrame(table)


def country_codes(spark: SparkSession) -> DataFrame:
    return country_aliases(spark).select("code", "country_name").distinct()


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(index: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, or null."""
    entries = ", ".join(_sql_text(text) for item in index.items() for text in item)
    return F.try_element_at(F.expr(f"map({entries})"), key)
