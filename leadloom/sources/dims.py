"""Small dimension tables: boxes of cities and codes of countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, north, south, east, west.
CITIES = [
    ("dubai", 25.358, 24.793, 55.565, 54.89),
    ("abu dhabi", 24.53, 24.32, 54.54, 54.28),
    ("abudhabi", 24.53, 24.32, 54.54, 54.28),
    ("sharjah", 25.42, 25.28, 55.59, 55.3),
    ("ajman", 25.43, 25.37, 55.52, 55.42),
    ("ras al khaimah", 25.85, 25.65, 55.98, 55.72),
    ("fujairah", 25.17, 25.08, 56.39, 56.28),
    ("riyadh", 24.85, 24.55, 46.85, 46.52),
    ("jeddah", 21.64, 21.35, 39.25, 39.08),
    ("mecca", 21.47, 21.37, 39.89, 39.78),
    ("medina", 24.51, 24.42, 39.64, 39.54),
    ("dammam", 26.48, 26.32, 50.17, 49.98),
    ("kuwait city", 29.42, 29.28, 48.1, 47.9),
    ("doha", 25.37, 25.23, 51.58, 51.45),
    ("manama", 26.25, 26.18, 50.61, 50.54),
    ("muscat", 23.65, 23.55, 58.6, 58.48),
    ("cairo", 30.2, 29.9, 31.4, 31.05),
    ("alexandria", 31.3, 31.1, 30.05, 29.8),
    ("karachi", 25.08, 24.78, 67.22, 66.8),
    ("lahore", 31.68, 31.38, 74.45, 74.15),
    ("islamabad", 33.78, 33.58, 73.18, 72.9),
    ("mumbai", 19.27, 18.89, 73.0, 72.78),
    ("delhi", 28.88, 28.4, 77.35, 76.84),
    ("new delhi", 28.88, 28.4, 77.35, 76.84),
    ("bangalore", 13.14, 12.83, 77.78, 77.45),
    ("bengaluru", 13.14, 12.83, 77.78, 77.45),
    ("hyderabad", 17.53, 17.27, 78.59, 78.32),
    ("chennai", 13.22, 12.96, 80.31, 80.12),
    ("london", 51.686, 51.286, 0.334, -0.51),
    ("manchester", 53.55, 53.4, -2.12, -2.31),
    ("birmingham", 52.55, 52.4, -1.77, -1.98),
    ("new york", 40.917, 40.477, -73.7, -74.259),
    ("los angeles", 34.337, 33.703, -118.155, -118.668),
    ("chicago", 42.023, 41.644, -87.524, -87.94),
    ("houston", 30.11, 29.52, -95.01, -95.79),
    ("miami", 25.855, 25.674, -80.125, -80.44),
    ("paris", 48.902, 48.816, 2.47, 2.224),
    ("berlin", 52.675, 52.338, 13.761, 13.0883),
    ("madrid", 40.564, 40.312, -3.524, -3.834),
    ("rome", 41.996, 41.796, 12.616, 12.354),
    ("amsterdam", 52.431, 52.313, 5.079, 4.789),
    ("istanbul", 41.176, 40.867, 29.235, 28.722),
    ("singapore", 1.4784, 1.2494, 104.0945, 103.594),
    ("kuala lumpur", 3.268, 3.058, 101.755, 101.587),
    ("bangkok", 13.954, 13.494, 100.935, 100.347),
    ("jakarta", -6.092, -6.372, 107.0, 106.682),
    ("tokyo", 35.817, 35.523, 139.92, 139.571),
    ("hong kong", 22.561, 22.178, 114.406, 113.826),
    ("beijing", 40.22, 39.755, 116.796, 116.032),
    ("shanghai", 31.479, 31.02, 121.735, 121.128),
    ("sydney", -33.578, -34.174, 151.343, 150.52),
    ("melbourne", -37.581, -38.174, 145.512, 144.593),
    ("toronto", 43.8554, 43.581, -79.115, -79.6393),
    ("vancouver", 49.314, 49.199, -123.023, -123.227),
]
# Name, code.
COUNTRIES = [
    ("united arab emirates", "ae"), ("uae", "ae"), ("saudi arabia", "sa"), ("ksa", "sa"), ("kuwait", "kw"),
    ("qatar", "qa"), ("bahrain", "bh"), ("oman", "om"), ("jordan", "jo"), ("lebanon", "lb"), ("iraq", "iq"),
    ("iran", "ir"), ("israel", "il"), ("palestine", "ps"), ("syria", "sy"), ("yemen", "ye"), ("egypt", "eg"),
    ("nigeria", "ng"), ("south africa", "za"), ("kenya", "ke"), ("ghana", "gh"), ("ethiopia", "et"),
    ("tanzania", "tz"), ("uganda", "ug"), ("morocco", "ma"), ("algeria", "dz"), ("tunisia", "tn"), ("libya", "ly"),
    ("sudan", "sd"), ("senegal", "sn"), ("cameroon", "cm"), ("angola", "ao"), ("mozambique", "mz"),
    ("zimbabwe", "zw"), ("zambia", "zm"), ("rwanda", "rw"), ("pakistan", "pk"), ("india", "in"), ("bangladesh", "bd"),
    ("sri lanka", "lk"), ("nepal", "np"), ("maldives", "mv"), ("afghanistan", "af"), ("singapore", "sg"),
    ("malaysia", "my"), ("thailand", "th"), ("indonesia", "id"), ("philippines", "ph"), ("vietnam", "vn"),
    ("cambodia", "kh"), ("myanmar", "mm"), ("laos", "la"), ("brunei", "bn"), ("timor-leste", "tl"), ("japan", "jp"),
    ("china", "cn"), ("hong kong", "hk"), ("taiwan", "tw"), ("south korea", "kr"), ("korea", "kr"),
    ("north korea", "kp"), ("mongolia", "mn"), ("kazakhstan", "kz"), ("uzbekistan", "uz"), ("turkmenistan", "tm"),
    ("kyrgyzstan", "kg"), ("tajikistan", "tj"), ("united kingdom", "gb"), ("uk", "gb"), ("great britain", "gb"),
    ("england", "gb"), ("germany", "de"), ("france", "fr"), ("spain", "es"), ("italy", "it"), ("netherlands", "nl"),
    ("turkey", "tr"), ("russia", "ru"), ("ukraine", "ua"), ("poland", "pl"), ("sweden", "se"), ("norway", "no"),
    ("denmark", "dk"), ("finland", "fi"), ("switzerland", "ch"), ("austria", "at"), ("belgium", "be"),
    ("portugal", "pt"), ("greece", "gr"), ("czech republic", "cz"), ("czechia", "cz"), ("hungary", "hu"),
    ("romania", "ro"), ("bulgaria", "bg"), ("croatia", "hr"), ("serbia", "rs"), ("slovakia", "sk"),
    ("slovenia", "si"), ("ireland", "ie"), ("scotland", "gb"), ("wales", "gb"), ("luxembourg", "lu"), ("malta", "mt"),
    ("cyprus", "cy"), ("iceland", "is"), ("albania", "al"), ("north macedonia", "mk"), ("bosnia", "ba"),
    ("montenegro", "me"), ("moldova", "md"), ("latvia", "lv"), ("lithuania", "lt"), ("estonia", "ee"),
    ("belarus", "by"), ("georgia", "ge"), ("armenia", "am"), ("azerbaijan", "az"), ("united states", "us"),
    ("usa", "us"), ("united states of america", "us"), ("canada", "ca"), ("mexico", "mx"), ("brazil", "br"),
    ("argentina", "ar"), ("colombia", "co"), ("chile", "cl"), ("peru", "pe"), ("venezuela", "ve"), ("ecuador", "ec"),
    ("bolivia", "bo"), ("paraguay", "py"), ("uruguay", "uy"), ("cuba", "cu"), ("dominican republic", "do"),
    ("puerto rico", "pr"), ("jamaica", "jm"), ("haiti", "ht"), ("panama", "pa"), ("costa rica", "cr"),
    ("guatemala", "gt"), ("honduras", "hn"), ("el salvador", "sv"), ("nicaragua", "ni"), ("australia", "au"),
    ("new zealand", "nz"), ("fiji", "fj"), ("papua new guinea", "pg"),
]


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CITIES, "name string, north double, south double, east double, west double")


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, "name string, code string")


def with_city_box(df: DataFrame, city: str) -> DataFrame:
    """df with north, south, east, west of the city; null where it is not known."""
    dim = cities(df.sparkSession).withColumnRenamed("name", "__name")
    return df.join(F.broadcast(dim), F.lower(F.trim(city)) == F.col("__name"), "left").drop("__name")


def with_country_code(df: DataFrame, country: str) -> DataFrame:
    """df with code: two letters are a code already, other names are looked up."""
    dim = countries(df.sparkSession).select(F.col("name").alias("__name"), F.col("code").alias("__code"))
    key: Column = F.lower(F.trim(country))
    joined = df.join(F.broadcast(dim), key == F.col("__name"), "left")
    return joined.withColumn("code", F.when(F.length(key) == 2, key).otherwise(F.col("__code"))).drop("__name", "__code")


def geocode(places: DataFrame, cache: DataFrame, hits: DataFrame) -> DataFrame:
    """places(..., location, country) with source, north, south, east, west and importance of each.

    In this order: cache(key, north, ...), whose key is the lower-case location and country around a bar; the known
    cities; the best of hits(query, code, boundingbox, importance, n) for the location with the country's code, by
    importance and then by n, among those with a box of four numbers [south, north, west, east]; the best hit for
    "location, country" without a code.  source says which one it was, 'none' if none.
    """
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    box = ["north", "south", "east", "west"]
    rows = with_country_code(places.withColumn("__country", F.nullif(F.trim("country"), F.lit(""))), "__country").withColumnRenamed("code", "__code")
    rows = rows.withColumn("__key", F.concat(norm(F.col("location")), F.lit("|"), norm(F.col("country"))))
    rows = rows.join(cache.select(F.col("key").alias("__key"), F.struct(*box, "importance").alias("__cached")), "__key", "left")
    known = cities(places.sparkSession).select(F.col("name").alias("__name"), F.struct(*box, F.lit(1.0).alias("importance")).alias("__city"))
    rows = rows.join(F.broadcast(known), norm(F.col("location")) == F.col("__name"), "left")
    numbers = F.transform("boundingbox", lambda x: x.try_cast("double"))
    good = hits.where(F.size("boundingbox") == 4).select("query", F.coalesce("code", F.lit("")).alias("code"), "importance", "n", numbers.alias("b"))
    best = good.groupBy("query", "code").agg(F.max(F.struct(F.coalesce("importance", F.lit(0.0)).alias("importance"), (-F.col("n")).alias("minus"), "b")).alias("t"))
    b = lambda i: F.col("t.b")[i]
    best = best.select("query", "code", F.struct(b(1).alias("north"), b(0).alias("south"), b(3).alias("east"), b(2).alias("west"), F.col("t.importance").alias("importance")).alias("hit"))
    named = lambda q, c, hit: best.select(F.col("query").alias(q), F.col("code").alias(c), F.col("hit").alias(hit))
    rows = rows.join(named("__q1", "__c1", "__hit"), (F.col("location") == F.col("__q1")) & (F.coalesce("__code", F.lit("")) == F.col("__c1")), "left")
    longer = F.when(F.col("__country").isNotNull(), F.concat("location", F.lit(", "), "country"))
    rows = rows.join(named("__q2", "__c2", "__far"), (longer == F.col("__q2")) & (F.col("__c2") == ""), "left")
    steps = {"cache": "__cached", "predefined": "__city", "hit": "__hit", "hit with country": "__far"}
    source, found = F.lit("none"), F.coalesce(*steps.values())
    for name, c in reversed(steps.items()):
        source = F.when(F.col(c).isNotNull(), name).otherwise(source)
    return rows.select(*places.columns, source.alias("source"), *[found[k].alias(k) for k in (*box, "importance")])
