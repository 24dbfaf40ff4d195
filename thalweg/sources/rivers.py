"""Tables about rivers, gauges, seas and history: fixed values that names, calibration and facts need."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# West, south, east, north of the study area, degrees.
STUDY_AREA = (-25.0, 33.0, 62.0, 72.0)

# Mean discharge at the mouth, cubic metres a second.
GAUGED = {
    "Volga": 8060, "Danube": 6500, "Dnipro": 1670, "Rhine": 2330, "Neva": 2490, "Vistula": 1080, "Elbe": 870, "Rhône": 1710, "Po": 1540,
    "Loire": 840, "Don": 900, "Pechora": 4100, "Oder": 570, "Duero": 700, "Ebro": 430, "Tejo": 444, "Seine": 560, "Dniester": 310, "Neman": 678,
    "Kura": 575, "Vychegda": 1160, "Tobol": 805, "Ural": 400, "Glomma": 700, "Kemijoki": 556, "Mezen": 890, "Onega": 505, "Garonne": 650,
    "Weser": 327, "Guadalquivir": 164, "Guadiana": 80, "Shannon": 200, "Severn": 107, "Thames": 66, "Dordogne": 300, "Adour": 350, "Charente": 50,
    "Somme": 35, "Ems": 80, "Sakarya": 193,
}

# Names that mean one river, lower case, and its name here.
ALIASES = {
    "donau": "Danube", "dunaj": "Danube", "duna": "Danube", "dunav": "Danube", "dunarea": "Danube", "dunărea": "Danube", "dunay": "Danube",
    "rhein": "Rhine", "rijn": "Rhine", "rhin": "Rhine", "reno": "Rhine", "wisla": "Vistula", "wisła": "Vistula", "weichsel": "Vistula",
    "odra": "Oder", "labe": "Elbe", "vltava": "Vltava", "dnieper": "Dnipro", "dnepr": "Dnipro", "dnyapro": "Dnipro", "dnestr": "Dniester",
    "nistru": "Dniester", "tajo": "Tejo", "tagus": "Tejo", "douro": "Duero", "maas": "Meuse", "rhone": "Rhône", "rhône": "Rhône", "morava": "Morava",
    "mura": "Mur", "drau": "Drava", "drau/drava": "Drava", "theiss": "Tisza", "tisa": "Tisza", "ticino": "Ticino", "nemunas": "Neman",
    "memel": "Neman", "niemen": "Neman", "zapadnaya dvina": "Daugava", "western dvina": "Daugava", "severnaya dvina": "Severnaya Dvina",
    "northern dvina": "Severnaya Dvina", "po": "Po", "sava": "Sava", "inn": "Inn", "isar": "Isar", "tevere": "Tiber", "etsch": "Adige",
    "adige/etsch": "Adige", "ebre": "Ebro", "garona": "Garonne", "loira": "Loire", "seine": "Seine", "somme": "Somme", "escaut": "Scheldt",
    "schelde": "Scheldt", "vah": "Váh", "váh": "Váh", "waag": "Váh", "al furat": "Euphrates", "dijlah": "Tigris",
}

# Other names under which facts are asked for; these are told apart by case.
FACT_ALIASES = {
    "Donau": "Danube", "Dunaj": "Danube", "Duna": "Danube", "Dunav": "Danube", "Dunărea": "Danube", "Rhein": "Rhine", "Rijn": "Rhine",
    "Rhin": "Rhine", "Wisła": "Vistula", "Wisla": "Vistula", "Odra": "Oder", "Dnieper": "Dnipro", "Dnepr": "Dnipro", "Tagus": "Tejo", "Tajo": "Tejo",
    "Douro": "Duero", "Maas": "Meuse", "Rhone": "Rhône", "Northern Dvina": "Severnaya Dvina", "Tevere": "Tiber", "Etsch": "Adige",
    "Nemunas": "Neman", "Memel": "Neman", "Western Dvina": "Daugava", "Zapadnaya Dvina": "Daugava", "Loira": "Loire", "Rin": "Rhine",
}

# River, length km, basin km2, discharge m3/s, source, tributaries.
FACTS = [
    ("Danube", 2850, 801463, 6500, "Black Forest, Germany", ["Inn", "Tisza", "Sava", "Drava", "Siret", "Prut", "Olt"]),
    ("Rhine", 1230, 185000, 2330, "Lake Toma, Swiss Alps", ["Aare", "Neckar", "Main", "Moselle", "Ruhr", "Lippe"]),
    ("Volga", 3531, 1360000, 8060, "Valdai Hills, Russia", ["Oka", "Kama", "Vetluga", "Sura"]),
    ("Elbe", 1094, 148268, 870, "Krkonoše mountains, Czechia", ["Vltava", "Saale", "Havel", "Mulde"]),
    ("Loire", 1006, 117000, 840, "Mont Gerbier de Jonc, Ardèche", ["Allier", "Cher", "Vienne", "Maine"]),
    ("Rhône", 813, 98000, 1710, "Rhône Glacier, Valais", ["Saône", "Isère", "Durance", "Ardèche"]),
    ("Seine", 777, 78650, 560, "Source-Seine, Burgundy", []),
    ("Po", 652, 74000, 1540, "Monviso, Piedmont", ["Ticino", "Adda", "Oglio", "Mincio", "Tanaro"]),
    ("Vistula", 1047, 194424, 1080, "Barania Góra, Silesian Beskids", []),
    ("Oder", 854, 118861, 570, "Oderské vrchy, Czechia", []),
    ("Dnipro", 2201, 504000, 1670, "Valdai Hills, Russia", []),
    ("Don", 1870, 425600, 900, "Central Russian Upland", []),
    ("Ebro", 930, 85530, 430, "Cantabrian Mountains", []),
    ("Tejo", 1007, 80100, 444, "Sierra de Albarracín", []),
    ("Duero", 897, 98375, 700, "Picos de Urbión", []),
    ("Guadalquivir", 657, 57527, 164, None, []),
    ("Guadiana", 742, 67733, 79, None, []),
    ("Thames", 346, 12935, 66, None, []),
    ("Severn", 354, 11420, 107, None, []),
    ("Shannon", 360, 16865, 208, None, []),
    ("Weser", 452, 46306, 327, None, []),
    ("Meuse", 925, 34548, 350, None, []),
    ("Garonne", 602, 55000, 650, "Val d'Aran, Pyrenees", []),
    ("Glomma", 621, 41918, 700, None, []),
    ("Kemijoki", 550, 51127, 556, None, []),
    ("Neva", 74, 281000, 2500, None, []),
    ("Severnaya Dvina", 744, 357052, 3332, None, []),
    ("Pechora", 1809, 322000, 4100, None, []),
    ("Kama", 1805, 507000, 4100, None, []),
    ("Ural", 2428, 231000, 400, None, []),
    ("Daugava", 1020, 87900, 678, None, []),
    ("Neman", 937, 98200, 616, None, []),
    ("Sava", 990, 97713, 1722, None, []),
    ("Tisza", 966, 156087, 794, None, []),
    ("Inn", 518, 26130, 735, None, []),
    ("Drava", 749, 40154, 577, None, []),
    ("Adige", 410, 12100, 235, None, []),
    ("Tiber", 406, 17375, 239, None, []),
    ("Dniester", 1352, 72100, 310, None, []),
    ("Torne", 522, 40157, 380, None, []),
]

# Marine area, the sea that a drop reaches through it, the group of seas.
SEA_GROUPS = {
    "North Atlantic Ocean": ("Atlantic Ocean", "atlantic"), "South Atlantic Ocean": ("Atlantic Ocean", "atlantic"),
    "Bay of Biscay": ("Atlantic Ocean", "atlantic"), "Celtic Sea": ("Atlantic Ocean", "atlantic"), "Irish Sea": ("Atlantic Ocean", "atlantic"),
    "English Channel": ("Atlantic Ocean", "atlantic"), "Bristol Channel": ("Atlantic Ocean", "atlantic"),
    "Inner Seas": ("Atlantic Ocean", "atlantic"), "North Sea": ("North Sea", "northsea"), "Skagerrak": ("North Sea", "northsea"),
    "Kattegat": ("Baltic Sea", "baltic"), "Baltic Sea": ("Baltic Sea", "baltic"), "Gulf of Bothnia": ("Baltic Sea", "baltic"),
    "Gulf of Finland": ("Baltic Sea", "baltic"), "Gulf of Riga": ("Baltic Sea", "baltic"),
    "Mediterranean Sea": ("Mediterranean Sea", "mediterranean"), "Adriatic Sea": ("Mediterranean Sea", "mediterranean"),
    "Aegean Sea": ("Mediterranean Sea", "mediterranean"), "Ionian Sea": ("Mediterranean Sea", "mediterranean"),
    "Tyrrhenian Sea": ("Mediterranean Sea", "mediterranean"), "Ligurian Sea": ("Mediterranean Sea", "mediterranean"),
    "Alboran Sea": ("Mediterranean Sea", "mediterranean"), "Balearic Sea": ("Mediterranean Sea", "mediterranean"),
    "Sea of Marmara": ("Mediterranean Sea", "mediterranean"), "Black Sea": ("Black Sea", "black"), "Sea of Azov": ("Black Sea", "black"),
    "Arctic Ocean": ("Arctic Ocean", "arctic"), "Barents Sea": ("Arctic Ocean", "arctic"), "White Sea": ("Arctic Ocean", "arctic"),
    "Greenland Sea": ("Arctic Ocean", "arctic"), "Norwegian Sea": ("Norwegian Sea", "arctic"), "Kara Sea": ("Arctic Ocean", "arctic"),
    "Caspian Sea": ("Caspian Sea", "caspian"), "Golfe du Lion": ("Mediterranean Sea", "mediterranean"),
    "Gulf of Lion": ("Mediterranean Sea", "mediterranean"), "Sea of Crete": ("Mediterranean Sea", "mediterranean"),
    "Gulf of Gabès": ("Mediterranean Sea", "mediterranean"), "Gulf of Sidra": ("Mediterranean Sea", "mediterranean"),
    "Strait of Gibraltar": ("Mediterranean Sea", "mediterranean"), "Dardanelles": ("Mediterranean Sea", "mediterranean"),
    "Bosporus": ("Black Sea", "black"), "Garabogaz Bay": ("Caspian Sea", "caspian"), "Stettiner Haff": ("Baltic Sea", "baltic"),
    "Mecklenburger Bucht": ("Baltic Sea", "baltic"), "Øresund": ("Baltic Sea", "baltic"), "Kaliningrad": ("Baltic Sea", "baltic"),
    "Waddenzee": ("North Sea", "northsea"), "Trondheimsfjorden": ("Norwegian Sea", "arctic"), "Vestfjorden": ("Norwegian Sea", "arctic"),
    "Sognefjorden": ("Norwegian Sea", "arctic"), "Boknafjorden": ("North Sea", "northsea"), "Kangertittivaq": ("Arctic Ocean", "arctic"),
    "Denmark Strait": ("Atlantic Ocean", "atlantic"),
}

# Year, last year, title, river, lon, lat, kind.
HISTORY = [
    (1600, 1650, "Draining the Fens", "Great Ouse", 0.15, 52.5, "drainage"),
    (1681, None, "Canal du Midi opens", "Garonne / Aude", 2.0, 43.4, "canal"),
    (1717, None, "Christmas Flood", "Ems / Weser", 7.5, 53.4, "disaster"),
    (1817, 1876, "Tulla straightens the Upper Rhine", "Rhine", 8.0, 48.8, "straightening"),
    (1846, 1880, "Regulation of the Tisza", "Tisza", 20.2, 46.9, "straightening"),
    (1869, None, "Suez opens; Danube commission grows", "Danube", 29.6, 45.2, "canal"),
    (1892, None, "Kiel Canal", "Eider", 9.6, 54.3, "canal"),
    (1932, None, "Afsluitdijk closes the Zuiderzee", "IJssel", 5.2, 53.0, "barrier"),
    (1938, 1975, "Rhône canalisation", "Rhône", 4.8, 44.5, "reservoir"),
    (1953, None, "North Sea flood", "Scheldt / Meuse", 4.0, 51.7, "disaster"),
    (1955, 1958, "Kuibyshev and the Volga cascade", "Volga", 49.4, 53.5, "reservoir"),
    (1956, None, "Kakhovka reservoir fills", "Dnipro", 33.4, 46.8, "reservoir"),
    (1964, None, "Ijsselmeer polders complete", "IJssel", 5.6, 52.5, "drainage"),
    (1972, 1984, "Iron Gates I and II", "Danube", 22.5, 44.7, "reservoir"),
    (1982, None, "Thames Barrier", "Thames", 0.04, 51.5, "barrier"),
    (1986, None, "Sandoz spill", "Rhine", 7.6, 47.6, "disaster"),
    (1997, None, "Oder flood", "Oder", 17.0, 51.1, "disaster"),
    (1997, 1998, "Loire dam removals", "Loire", 0.5, 47.2, "removal"),
    (2002, None, "Alqueva fills", "Guadiana", -7.5, 38.2, "reservoir"),
    (2006, 2015, "Room for the River", "Rhine / Waal", 5.9, 51.9, "removal"),
    (2009, None, "Kárahnjúkar", "Jökulsá á Dal", -15.8, 64.9, "reservoir"),
    (2018, 2022, "Sélune dam removals", "Sélune", -1.2, 48.6, "removal"),
    (2021, None, "Ahr valley flood", "Rhine", 7.1, 50.5, "disaster"),
    (2022, None, "Po drought", "Po", 11.0, 45.0, "disaster"),
    (2023, None, "Kakhovka dam destroyed", "Dnipro", 33.37, 46.78, "disaster"),
]

# Groups of seas by boxes (least and largest longitude, least and largest latitude, None without a limit), in the
# order in which they count, and the group of what lies in none.
SEA_BOXES = [
    ("caspian", [(45, None, 36, 48)]), ("black", [(26, 42, 40, 48)]), ("arctic", [(None, None, 66, None), (20, None, 62, None)]),
    ("mediterranean", [(-6, None, None, 46)]), ("baltic", [(9, 31, 53, 66)]), ("northsea", [(-5, 10, 51, 61)]),
]
OTHER_SEA = "atlantic"

# Points to start from, name, lon, lat.
START_POINTS = [
    ("A field near Munich", 11.58, 48.14), ("The Matterhorn", 7.66, 45.98), ("Snowdonia", -3.99, 53.07),
    ("Sierra de Gredos", -5.28, 40.25), ("Tatra Mountains", 20.0, 49.23), ("Icelandic highlands", -18.5, 64.7),
]


def gauges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in GAUGED.items()], "river string, discharge double")


def facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTS, "river string, length int, basin int, discharge int, source string, tributaries array<string>")


def history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HISTORY, "year int, until int, title string, river string, lon double, lat double, kind string")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def canonical(name: Column) -> Column:
    """A river's name without blanks at its ends, or the one name that it stands for."""
    plain = F.trim(name)
    return F.coalesce(F.try_element_at(_map(ALIASES), F.lower(plain)), plain)


def with_facts(rivers: DataFrame, name: str = "river") -> DataFrame:
    """rivers with the columns of facts() but its name; nulls where nothing is known."""
    spark = rivers.sparkSession
    known = facts(spark).withColumnRenamed("river", "__known")
    key = F.coalesce(F.try_element_at(_map(FACT_ALIASES), F.col(name)), F.col(name))
    return rivers.join(F.broadcast(known), key == F.col("__known"), "left").drop("__known")  # a literal table


def history_until(spark: SparkSession, year: int) -> DataFrame:
    """What had begun by a year, the latest first."""
    return history(spark).where(F.col("year") <= year).orderBy(F.desc("year"), F.desc("title"))


def begun(years: DataFrame, column: str) -> DataFrame:
    """years with what had begun by each of them: the columns of history()."""
    return years.join(F.broadcast(history(years.sparkSession)), F.col("year") <= F.col(column))  # a literal table


def sea_by_position(lon: Column, lat: Column) -> Column:
    """The group of seas of a point: that of the first box that it lies in, without its sides."""
    out = F.lit(OTHER_SEA)
    for group, held in reversed(SEA_BOXES):
        inside = [F.lit(True)]
        for box in held:
            sides = [v > low for v, low in zip((lon, lat), box[::2]) if low is not None] + [v < high for v, high in zip((lon, lat), box[1::2]) if high is not None]
            inside.append(reduce(operator.and_, sides))
        out = F.when(reduce(operator.or_, inside[1:]), group).otherwise(out)
    return out


def sea_of(marine: Column, lon: Column, lat: Column) -> Column:
    """struct sea, sea_group of a marine area; one that is in no table is its own sea, grouped by position."""
    sea, group = (F.try_element_at(_map({k: v[i] for k, v in SEA_GROUPS.items()}), marine) for i in (0, 1))
    return F.when(marine.isNotNull(), F.struct(F.coalesce(sea, marine).alias("sea"), F.coalesce(group, sea_by_position(lon, lat)).alias("sea_group")))
