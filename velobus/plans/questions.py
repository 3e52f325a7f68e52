"""The sixteen analytic questions.

Each function answers its question for all parameter values in one aggregation and returns the
measures together with the rendered answer. ``bikes`` and ``buses`` have the columns of the
stored tables; ``as_of`` ends the horizon (default: now).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velobus.functions.statistics import band, correlation, most_frequent, success_rate
from velobus.operators.asof import micros
from velobus.operators.feeds import latest_per_key
from velobus.operators.ordered import previous_value
from velobus.schemas import BAD_WEATHER, ENVIRONMENT_FACTORS, HEAVY_RAIN
from velobus.sources.tables import AsOf, within

HOURS = 2
DAYS = 7
LOW_BIKES = 5


def _answer(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values).alias("answer")


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _one_decimal(column: str) -> Column:
    return F.format_string("%.1f", F.col(column))


def _two_decimals(column: str | Column) -> Column:
    return F.format_string("%.2f", F.col(column) if isinstance(column, str) else column)


def station_cluster_status(
    bikes: DataFrame, as_of: AsOf = None, hours: int = HOURS, tie: list[str] | None = None
) -> DataFrame:
    """Q1: per station the cluster of the latest record, its success flag and rain."""
    latest = latest_per_key(
        within(bikes, as_of, hours=hours),
        ["name"],
        ["timestamp", *(tie or [])],
        ["cluster_id", "cluster_prediction_success", "precip_mm"],
    )
    rain = F.coalesce(F.col("precip_mm") > 0, F.lit(False))
    success = F.coalesce("cluster_prediction_success", F.lit(False))
    return latest.select(
        "name",
        "cluster_id",
        success.alias("success"),
        rain.alias("rain"),
        _answer(
            "Dla stacji rowerowej '%s': Id klastra to %s. Predykcja klastra była %s. "
            "W tym czasie występowały silne opady deszczu: %s.",
            F.col("name"),
            F.coalesce(_text("cluster_id"), F.lit("None")),
            F.when(success, "udana").otherwise("nieudana"),
            F.when(rain, "tak").otherwise("nie"),
        ),
    )


def cluster_delay_category(
    buses: DataFrame, as_of: AsOf = None, hours: int = HOURS
) -> DataFrame:
    """Q2: per bus cluster the number of vehicles and the dominant delay label."""
    label = F.nullif("delay_category_label", F.lit(""))
    counted = (
        within(buses, as_of, hours=hours)
        .where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id", "vehicle_id", label.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    vehicles = counted.groupBy("cluster_id").agg(F.count_distinct("vehicle_id").alias("vehicles"))
    labels = (
        counted.where(F.col("label").isNotNull())
        .groupBy("cluster_id", "label")
        .agg(F.sum("n").alias("n"))
        .groupBy("cluster_id")
        .agg(most_frequent("label", "n").alias("dominant"))
    )
    return (
        vehicles.join(labels, "cluster_id", "left")
        .withColumn("dominant", F.coalesce("dominant", F.lit("brak danych")))
        .select(
            "*",
            _answer(
                f"W ciągu ostatnich {hours} godzin, %s unikalnych autobusów należało do klastra "
                "o id '%s'. Dominująca kategoria opóźnienia dla tych autobusów to: '%s'.",
                _text("vehicles"), _text("cluster_id"), F.col("dominant"),
            ),
        )
    )


def mean_electric_bikes(bikes: DataFrame, as_of: AsOf = None, hours: int = HOURS) -> DataFrame:
    """Q3: mean electric bikes over rows whose binary scoring ran; null without such rows."""
    recent = within(bikes, as_of, hours=hours).where("bike_binary_prediction_success")
    return recent.agg(F.avg("electric_bikes_available").alias("mean_electric")).select(
        "*",
        F.coalesce(
            F.when(
                F.col("mean_electric").isNotNull(),
                F.format_string(
                    "Średnia liczba dostępnych rowerów elektrycznych dla wszystkich pomyślnych "
                    f"predykcji binarnych w ciągu ostatnich {hours} godzin wynosi: %.2f.",
                    F.col("mean_electric"),
                ),
            ),
            F.lit(
                "Brak danych o pomyślnych predykcjach binarnych rowerów w ciągu ostatnich "
                f"{hours} godzin."
            ),
        ).alias("answer"),
    )


def top_delay_label(buses: DataFrame, as_of: AsOf = None, hours: int = HOURS) -> DataFrame:
    """Q4: most common delay label among successes and its mean on-time ratio, in one pass."""
    return (
        within(buses, as_of, hours=hours)
        .where(F.col("delay_category_prediction_success"))
        .where(F.col("delay_category_label").isNotNull())
        .groupBy("delay_category_label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("on_time_stop_ratio").alias("mean_on_time_ratio"),
        )
        .orderBy(F.desc("n"), "delay_category_label")
        .limit(1)
        .select(
            "*",
            _answer(
                "Najczęściej występująca etykieta opóźnienia dla pomyślnych predykcji w ciągu "
                f"ostatnich {hours} godzin to: '%s'. Średnia wartość 'on_time_stop_ratio' dla "
                "tej etykiety wynosi: %s.",
                F.col("delay_category_label"), _two_decimals("mean_on_time_ratio"),
            ),
        )
    )


def low_availability_weather(
    bikes: DataFrame, as_of: AsOf = None, hours: int = HOURS
) -> DataFrame:
    """Q5: per bike cluster the most frequent weather while few bikes were available."""
    return (
        within(bikes, as_of, hours=hours)
        .where(F.col("cluster_id").isNotNull() & F.col("weather_condition").isNotNull())
        .where(F.col("bikes_available") < LOW_BIKES)
        .groupBy("cluster_id", "weather_condition")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("cluster_id")
        .agg(
            most_frequent("weather_condition", "n").alias("weather_condition"),
            F.max("n").alias("n"),
        )
        .select(
            "*",
            _answer(
                "Dla stacji rowerowych w klastrze o id '%s', które miały niską dostępność "
                f"rowerów w ciągu ostatnich {hours} godzin, najczęściej występującym warunkiem "
                "pogodowym było: '%s'.",
                _text("cluster_id"), F.col("weather_condition"),
            ),
        )
    )


def pm25_by_success(buses: DataFrame, as_of: AsOf = None, hours: int = HOURS) -> DataFrame:
    """Q6: per line the mean PM2.5 of successful and of other rows, with a verdict."""
    success = F.coalesce("delay_category_prediction_success", F.lit(False))
    pm25 = F.col("fine_particles_pm2_5")
    compared = (
        within(buses, as_of, hours=hours)
        .groupBy("bus_line_number")
        .agg(
            F.coalesce(F.avg(F.when(success, pm25)), F.lit(0.0)).alias("mean_success"),
            F.coalesce(F.avg(F.when(~success, pm25)), F.lit(0.0)).alias("mean_failure"),
        )
    )
    good, bad = F.col("mean_success"), F.col("mean_failure")
    verdict = (
        F.when((good > bad) & (bad != 0), "higher")
        .when((good < bad) & (good != 0), "lower")
        .otherwise("none")
    )
    phrase = (
        F.when(
            F.col("verdict") == "higher",
            "Tak, średnie stężenie PM2.5 dla pomyślnych predykcji było wyższe.",
        )
        .when(
            F.col("verdict") == "lower",
            "Tak, średnie stężenie PM2.5 dla pomyślnych predykcji było niższe.",
        )
        .otherwise(
            "Nie zaobserwowano wyraźnej różnicy w średnim stężeniu PM2.5 między pomyślnymi "
            "a niepomyślnymi predykcjami."
        )
    )
    return compared.withColumn("verdict", verdict).select(
        "*",
        _answer(
            "%s Średnie stężenie PM2.5 dla pomyślnych predykcji: %s. "
            "Dla niepomyślnych predykcji: %s.",
            phrase, _two_decimals("mean_success"), _two_decimals("mean_failure"),
        ),
    )


def _impact(corr: str, rise: str, name: str) -> Column:
    value = F.col(corr)
    sentence = "Wzrost %s ma tendencję do %s wpływu (korelacja %s) na prognozowaną liczbę rowerów."
    weak = "%s ma słaby wpływ (korelacja %s) na prognozowaną liczbę rowerów."
    shown = _two_decimals(value)
    return band(
        value,
        0.3,
        F.format_string(sentence, F.lit(rise), F.lit("pozytywnego"), shown),
        F.format_string(sentence, F.lit(rise), F.lit("negatywnego"), shown),
        F.format_string(weak, F.lit(name), shown),
    )


def forecast_correlations(
    bikes: DataFrame, as_of: AsOf = None, hours: int = HOURS
) -> DataFrame:
    """Q7: per station the correlation of humidity and temperature with the forecast."""
    forecast = F.col("bike_regression_prediction")
    grouped = (
        within(bikes, as_of, hours=hours)
        .where(
            F.col("humidity").isNotNull()
            & F.col("temperature").isNotNull()
            & forecast.isNotNull()
        )
        .groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            correlation(F.col("humidity"), forecast).alias("corr_humidity"),
            correlation(F.col("temperature"), forecast).alias("corr_temperature"),
        )
        .where(F.col("n") >= 2)
    )
    levels = [F.lit("positive"), F.lit("negative"), F.lit("weak")]
    sentences = F.concat_ws(
        " ",
        _impact("corr_humidity", "wilgotności", "Wilgotność"),
        _impact("corr_temperature", "temperatury", "Temperatura"),
    )
    return grouped.select(
        "*",
        band(F.col("corr_humidity"), 0.3, *levels).alias("humidity_impact"),
        band(F.col("corr_temperature"), 0.3, *levels).alias("temperature_impact"),
        _answer(
            "Dla stacji '%s': %s",
            F.col("name"),
            F.coalesce(
                F.nullif(sentences, F.lit("")),
                F.lit(
                    "Brak wyraźnego wpływu wilgotności i temperatury na prognozowaną liczbę "
                    "rowerów."
                ),
            ),
        ),
    )


def late_visibility(
    buses: DataFrame,
    as_of: AsOf = None,
    hours: int = HOURS,
    label_column: str = "delay_category_label",
    label: str = "bardzo spóźniony",
) -> DataFrame:
    """Q8: per line the most frequent visibility among rows of the worst delay label."""
    return (
        within(buses, as_of, hours=hours)
        .where((F.col(label_column) == label) & F.col("visibility_km").isNotNull())
        .groupBy("bus_line_number", "visibility_km")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bus_line_number")
        .agg(most_frequent("visibility_km", "n").alias("visibility_km"), F.max("n").alias("n"))
        .select(
            "*",
            _answer(
                "Autobusy linii '%s' najczęściej doświadczały opóźnień sklasyfikowanych jako "
                f"'{label}' przy widoczności wynoszącej około %s km w ciągu ostatnich {hours} "
                "godzin.",
                F.col("bus_line_number"),
                F.format_string("%.1f", F.col("visibility_km").cast("double")),
            ),
        )
    )


def high_uv_bikes_and_delay(
    bikes: DataFrame, buses: DataFrame, as_of: AsOf = None, days: int = DAYS, tz: str | None = None
) -> DataFrame:
    """Q9: per bike cluster at UV above 7 the mean bikes by type, and the mean bus delay over
    all pairs of same date and weather.

    Both sides are summed per (date, weather) before the join, so the pairs are never built:
    the pair mean is sum(bike rows * delay sum) / sum(bike rows * bus rows).
    """

    def day(frame: DataFrame) -> Column:
        time = F.col("timestamp")
        return F.to_date(F.from_utc_timestamp(time, tz) if tz else time)

    sunny = (
        within(bikes, as_of, days=days)
        .where(F.col("cluster_id").isNotNull() & (F.col("uv_index") > 7))
        .groupBy("cluster_id", day(bikes).alias("day"), "weather_condition")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("manual_bikes_available").alias("manual"),
            F.count("manual_bikes_available").alias("manual_n"),
            F.sum("electric_bikes_available").alias("electric"),
            F.count("electric_bikes_available").alias("electric_n"),
        )
    )
    delays = (
        within(buses, as_of, days=days)
        .where(F.col("average_delay_seconds").isNotNull())
        .groupBy(day(buses).alias("bus_day"), F.col("weather_condition").alias("bus_weather"))
        .agg(
            F.sum("average_delay_seconds").alias("delay_sum"),
            F.count(F.lit(1)).alias("bus_rows"),
        )
    )
    same = (sunny["day"] == delays["bus_day"]) & sunny["weather_condition"].eqNullSafe(
        delays["bus_weather"]
    )
    manual = F.try_divide(F.sum("manual"), F.sum("manual_n"))
    electric = F.try_divide(F.sum("electric"), F.sum("electric_n"))
    result = (
        sunny.join(delays, same, "left")
        .groupBy("cluster_id")
        .agg(
            manual.alias("mean_manual"),
            electric.alias("mean_electric"),
            F.when(manual > electric, "manual").otherwise("electric").alias("more"),
            F.try_divide(
                F.sum(F.col("rows") * F.col("delay_sum")),
                F.sum(F.when(F.col("bus_rows").isNotNull(), F.col("rows") * F.col("bus_rows"))),
            ).alias("mean_delay"),
        )
    )
    trend = "W dniach o wysokim UV, stacje w klastrze '%s' miały średnio więcej rowerów %s (%s) niż %s (%s)."
    manual_shown, electric_shown = _one_decimal("mean_manual"), _one_decimal("mean_electric")
    more_manual = F.col("more") == "manual"
    return result.select(
        "*",
        _answer(
            "%s %s",
            F.format_string(
                trend,
                _text("cluster_id"),
                F.when(more_manual, "manualnych").otherwise("elektrycznych"),
                F.when(more_manual, manual_shown).otherwise(electric_shown),
                F.when(more_manual, "elektrycznych").otherwise("manualnych"),
                F.when(more_manual, electric_shown).otherwise(manual_shown),
            ),
            F.when(
                F.col("mean_delay").isNotNull(),
                F.format_string(
                    "W dniach o wysokim UV i podobnych warunkach pogodowych, średnie opóźnienie "
                    "autobusów wynosiło %s sekund.",
                    _one_decimal("mean_delay"),
                ),
            ).otherwise("Brak danych o wpływie na opóźnienia autobusów w sąsiadujących obszarach."),
        ),
    )


def min_max_score(frame: DataFrame, value: str, descending: bool = False) -> Column:
    """Min-max normalisation over the frame; 0 without range. For small aggregated frames only:
    the whole frame is one window."""
    whole = Window.partitionBy()
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    distance = high - F.col(value) if descending else F.col(value) - low
    return F.when(high > low, distance / F.nullif(high - low, F.lit(0.0))).otherwise(0.0)


def best_hour(
    bikes: DataFrame,
    buses: DataFrame,
    as_of: AsOf = None,
    days: int = DAYS,
    by: str = "hour",
) -> DataFrame:
    """Q10: the hour with many bikes and short delays among hours of little cloud.

    Groups by absolute hour; ``by="hour_of_day"`` pools the same hour of all days. The two hourly
    tables have at most 24 rows per day of the horizon.
    """
    hour = F.hour("timestamp") if by == "hour_of_day" else F.date_trunc("hour", "timestamp")
    bike_hours = (
        within(bikes, as_of, days=days)
        .where(F.col("cloud").isNotNull())
        .groupBy(hour.alias("hour"))
        .agg(F.avg("bikes_available").alias("mean_bikes"), F.avg("cloud").alias("bike_cloud"))
    )
    bus_hours = (
        within(buses, as_of, days=days)
        .where(F.col("cloud").isNotNull())
        .groupBy(hour.alias("hour"))
        .agg(F.avg("average_delay_seconds").alias("mean_delay"), F.avg("cloud").alias("bus_cloud"))
    )
    clear = bike_hours.join(bus_hours, "hour").where(
        (F.col("bike_cloud") < 20) & (F.col("bus_cloud") < 20)
    )
    score = min_max_score(clear, "mean_bikes") + min_max_score(clear, "mean_delay", True)
    shown = F.col("hour") if by == "hour_of_day" else F.hour("hour")
    return (
        clear.withColumn("score", score)
        .orderBy(F.desc_nulls_last("score"), "hour")
        .limit(1)
        .select(
            "hour",
            "mean_bikes",
            "mean_delay",
            "score",
            _answer(
                f"W ciągu ostatnich {days} dni, przy niskim zachmurzeniu, optymalna godzina dobowa "
                "to około %s:00. W tym czasie średnia dostępność rowerów to %s, a średnie "
                "opóźnienie autobusów to %s sekund.",
                _text(shown), _one_decimal("mean_bikes"), _one_decimal("mean_delay"),
            ),
        )
    )


def top_factors(
    buses: DataFrame,
    as_of: AsOf = None,
    days: int = DAYS,
    factors: list[str] | None = None,
    top: int = 3,
) -> DataFrame:
    """Q11: the factors most correlated with scoring success; all correlations in one pass."""
    factors = factors or ENVIRONMENT_FACTORS
    flag = F.col("delay_category_prediction_success")
    wide = (
        within(buses, as_of, days=days)
        .where(flag.isNotNull())
        .agg(*[correlation(flag.cast("int"), F.col(f)).alias(f) for f in factors])
    )
    places = F.create_map(*[F.lit(x) for i, f in enumerate(factors) for x in (f, i)])
    return (
        wide.unpivot([], factors, "factor", "correlation")
        .where(F.col("correlation").isNotNull())
        .orderBy(F.desc(F.abs("correlation")), places[F.col("factor")])
        .limit(top)
        .withColumn(
            "impact", F.when(F.col("correlation") > 0, "pozytywny").otherwise("negatywny")
        )
    )


def top_factors_answer(ranked: DataFrame) -> DataFrame:
    """Q11 rendered: the ranked factors (three rows) as one sentence."""
    size = F.abs("correlation")
    rows = F.array_sort(
        F.collect_list(F.struct((-size).alias("key"), "factor", "correlation", "impact"))
    )
    parts = F.transform(
        rows,
        lambda r, i: F.format_string(
            "%s. %s (korelacja: %.2f, wpływ: %s).",
            (i + 1).cast("string"), r["factor"], r["correlation"], r["impact"],
        ),
    )
    lead = (
        "Trzy główne czynniki środowiskowe, które najbardziej wpływają na prognozowany sukces "
        "klasyfikacji opóźnień autobusów to: "
    )
    none = (
        "Brak wyraźnych korelacji między czynnikami środowiskowymi a sukcesem predykcji opóźnień "
        "autobusów."
    )
    return ranked.agg(parts.alias("parts")).select(
        F.when(F.size("parts") > 0, F.concat(F.lit(lead), F.concat_ws(" ", "parts")))
        .otherwise(none)
        .alias("answer")
    )


def sector_success(
    bikes: DataFrame, buses: DataFrame, as_of: AsOf = None, days: int = DAYS
) -> DataFrame:
    """Q12: clustering success rate and mean temperature of successes, bikes against buses."""

    def side(frame: DataFrame, sector: str) -> DataFrame:
        return within(frame, as_of, days=days).select(
            F.lit(sector).alias("sector"),
            F.coalesce("cluster_prediction_success", F.lit(False)).alias("ok"),
            F.col("temperature").cast("double").alias("temperature"),
        )

    rates = (
        side(bikes, "bike")
        .unionByName(side(buses, "bus"))
        .groupBy("sector")
        .agg(
            success_rate(F.col("ok")).alias("rate"),
            F.avg(F.when(F.col("ok"), F.col("temperature"))).alias("temp"),
        )
    )

    def pick(sector: str, column: str) -> Column:
        return F.max(F.when(F.col("sector") == sector, F.col(column)))

    row = rates.agg(
        F.coalesce(pick("bike", "rate"), F.lit(0.0)).alias("bike_rate"),
        pick("bike", "temp").alias("bike_temp"),
        F.coalesce(pick("bus", "rate"), F.lit(0.0)).alias("bus_rate"),
        pick("bus", "temp").alias("bus_temp"),
    )
    bike, bus = F.col("bike_rate"), F.col("bus_rate")
    row = row.withColumn(
        "winner", F.when(bike > bus, "bike").when(bus > bike, "bus").otherwise("equal")
    )
    return row.select(
        "*",
        _answer(
            f"W ciągu ostatnich {days} dni: "
            "Dla stacji rowerowych, wskaźnik sukcesu predykcji klasteryzacji to %.2f%%. "
            "Średnia temperatura dla pomyślnych predykcji rowerowych: %.1f°C. "
            "Dla linii autobusowych, wskaźnik sukcesu predykcji klasteryzacji to %.2f%%. "
            "Średnia temperatura dla pomyślnych predykcji autobusowych: %.1f°C. %s",
            bike, F.col("bike_temp"), bus, F.col("bus_temp"),
            F.when(
                F.col("winner") == "bike",
                "Sektor rowerowy wykazał wyższy wskaźnik sukcesu klasteryzacji.",
            )
            .when(
                F.col("winner") == "bus",
                "Sektor autobusowy wykazał wyższy wskaźnik sukcesu klasteryzacji.",
            )
            .otherwise("Wskaźniki sukcesu klasteryzacji w obu sektorach były podobne."),
        ),
    )


def station_needing_refill(
    bikes: DataFrame,
    as_of: AsOf = None,
    span: int = HOURS,
    unit: str = "hours",
    tie: list[str] | None = None,
) -> DataFrame:
    """Q13: the station most often low in bad weather, with its latest record, in one pass.

    Ties go to the station that was low most recently, then to the smaller name.
    """
    low = (F.col("bikes_available") < LOW_BIKES) & F.col("weather_condition").isin(BAD_WEATHER)
    latest = F.max_by(
        F.struct("bikes_available", "bike_regression_prediction", "weather_condition"),
        F.struct("timestamp", *(tie or [])),
    )
    return (
        within(bikes, as_of, **{unit: span})
        .groupBy("name")
        .agg(
            F.count_if(low).alias("times_low"),
            F.max(F.when(low, F.col("timestamp"))).alias("_last_low"),
            latest.alias("_latest"),
        )
        .where(F.col("times_low") > 0)
        .orderBy(F.desc("times_low"), F.desc("_last_low"), "name")
        .limit(1)
        .select(
            "name",
            "times_low",
            "_latest.*",
            _answer(
                "Stacja '%s' najprawdopodobniej wymagała uzupełnienia rowerów w ciągu ostatnich "
                f"{span} godzin. Ostatnia zarejestrowana dostępność rowerów: %s, prognozowana "
                "dostępność: %.1f, warunki pogodowe: '%s'.",
                F.col("name"),
                _text("_latest.bikes_available"),
                F.col("_latest.bike_regression_prediction"),
                F.col("_latest.weather_condition"),
            ),
        )
    )


def rain_delay_lines(
    buses: DataFrame, as_of: AsOf = None, days: int = DAYS, top: int = 3
) -> DataFrame:
    """Q14: the lines with most rows of long delay, heavy rain and successful scoring."""
    return (
        within(buses, as_of, days=days)
        .where(
            (F.col("average_delay_seconds") > 300)
            & (F.col("precip_mm") > 5)
            & F.col("weather_condition").isin(HEAVY_RAIN)
            & F.col("delay_category_prediction_success")
        )
        .groupBy("bus_line_number")
        .agg(F.count("bus_line_number").alias("n"))
        .orderBy(F.desc("n"), "bus_line_number")
        .limit(top)
    )


def rain_delay_lines_answer(ranked: DataFrame, days: int = DAYS) -> DataFrame:
    """Q14 rendered: the ranked lines (three rows) as one sentence."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("key"), "bus_line_number")))
    parts = F.transform(
        rows,
        lambda r: F.format_string(
            "%s (liczba zdarzeń: %s).", r["bus_line_number"], (-r["key"]).cast("string")
        ),
    )
    lead = (
        f"W ciągu ostatnich {days} dni, trasy autobusowe najbardziej podatne na duże opóźnienia "
        "przy znaczących opadach deszczu (zgodnie z klasyfikacjami ML) to: "
    )
    none = (
        "Brak danych o trasach autobusowych spełniających kryteria dużych opóźnień przy deszczu "
        f"w ciągu ostatnich {days} dni."
    )
    return ranked.agg(parts.alias("parts")).select(
        F.when(F.size("parts") > 0, F.concat(F.lit(lead), F.concat_ws(" ", "parts")))
        .otherwise(none)
        .alias("answer")
    )


def pollution_and_docks(
    bikes: DataFrame,
    as_of: AsOf = None,
    days: int = DAYS,
    jump: int = 5,
    tie: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Q15: mean PM2.5 at sudden dock increases, and its correlation with free docks."""
    known = (
        within(bikes, as_of, days=days)
        .where(F.col("fine_particles_pm2_5").isNotNull() & F.col("docks_available").isNotNull())
        .select(
            "station_id", "timestamp", *(tie or []), "fine_particles_pm2_5", "docks_available"
        )
    )
    moved = previous_value(
        known,
        ["station_id"],
        micros(F.col("timestamp")),
        tie or [],
        "docks_available",
        "previous_docks",
        slices,
    )
    sudden = F.col("docks_available") - F.col("previous_docks") > jump
    pm25 = F.col("fine_particles_pm2_5")
    row = moved.agg(
        F.count_if(sudden).alias("sudden_increases"),
        F.avg(F.when(sudden, pm25)).alias("mean_pm25"),
        correlation(pm25, F.col("docks_available")).alias("corr"),
    )
    verdict = F.coalesce(
        band(F.col("corr"), 0.3, F.lit("positive"), F.lit("negative"), F.lit("weak")),
        F.lit("unknown"),
    )
    phrase = (
        F.when(
            F.col("verdict") == "positive",
            "Tak, istnieje pozytywna korelacja (wzrost zanieczyszczeń koreluje ze wzrostem "
            "dostępności doków, czyli spadkiem wypożyczeń).",
        )
        .when(
            F.col("verdict") == "negative",
            "Nie, istnieje negatywna korelacja (wzrost zanieczyszczeń koreluje ze spadkiem "
            "dostępności doków, czyli wzrostem wypożyczeń).",
        )
        .when(
            F.col("verdict") == "weak",
            "Brak wyraźnej korelacji między wzrostem zanieczyszczeń a dostępnością doków.",
        )
        .otherwise("Brak wystarczających danych do obliczenia korelacji.")
    )
    return row.withColumn("verdict", verdict).select(
        "*",
        F.when(
            F.col("sudden_increases") > 0,
            F.format_string(
                "%s Średnie stężenie PM2.5 w dniach, gdy dostępność doków gwałtownie rosła: "
                "%.2f µg/m³.",
                phrase, F.col("mean_pm25"),
            ),
        )
        .otherwise(
            "Brak zdarzeń gwałtownego wzrostu dostępności doków (spadku wypożyczeń) w "
            "analizowanym okresie."
        )
        .alias("answer"),
    )


def latest_sentences(
    sectors: dict[str, DataFrame],
    as_of: AsOf = None,
    days: int = DAYS,
    tie: list[str] | None = None,
) -> DataFrame:
    """Q16: the newest non-empty sentence per sector."""
    parts = [
        within(frame, as_of, days=days)
        .where(F.col("summary_sentence") != "")
        .select(F.lit(sector).alias("sector"), "timestamp", *(tie or []), "summary_sentence")
        for sector, frame in sectors.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return latest_per_key(
        union, ["sector"], ["timestamp", *(tie or [])], ["summary_sentence"]
    )


# The narrative around the two sentences of Q16.
STRATEGY_LEAD = (
    "Oto podsumowania z danych z ostatnich {days} dni, które mogą posłużyć do sformułowania "
    "strategii optymalizacji:"
)
STRATEGY_INSIGHTS = (
    "Analiza danych z ostatnich 7 dni wskazuje, że: "
    "1. Klasteryzacja stacji rowerowych może pomóc w identyfikacji obszarów o zmiennym "
    "zapotrzebowaniu na rowery. "
    "2. Prognozy opóźnień autobusów, zwłaszcza te z wysoką pewnością, są kluczowe dla zarządzania "
    "ruchem. "
    "3. Warunki pogodowe, takie jak opady i temperatura, mają wyraźny wpływ na dostępność rowerów "
    "i punktualność autobusów. "
    "4. Wysokie zanieczyszczenia mogą wpływać na preferencje transportowe. "
    "LLM powinien na podstawie tych informacji oraz konkretnych summary_sentence zasugerować "
    "strategie, np. dynamiczne przemieszczanie rowerów w zależności od prognoz pogody i klastrów, "
    "lub dostosowanie rozkładów jazdy autobusów w oparciu o przewidywane opóźnienia w "
    "specyficznych warunkach środowiskowych."
)
NO_BIKE_SENTENCE = "Brak podsumowań dla danych rowerowych."
NO_BUS_SENTENCE = "Brak podsumowań dla danych autobusowych."


def optimization_summary(
    bikes: DataFrame, buses: DataFrame, as_of: AsOf = None, days: int = DAYS
) -> DataFrame:
    """Q16 rendered: both sentences inside the fixed narrative."""
    latest = latest_sentences({"bike": bikes, "bus": buses}, as_of, days)

    def of(sector: str, default: str) -> Column:
        found = F.max(F.when(F.col("sector") == sector, F.col("summary_sentence")))
        return F.coalesce(found, F.lit(default))

    return latest.agg(
        F.format_string(
            "%s\n\nPodsumowanie dla rowerów: '%s'\nPodsumowanie dla autobusów: '%s'\n\n"
            "Ogólne wnioski do rozważenia przez LLM: %s",
            F.lit(STRATEGY_LEAD.format(days=days)),
            of("bike", NO_BIKE_SENTENCE),
            of("bus", NO_BUS_SENTENCE),
            F.lit(STRATEGY_INSIGHTS),
        ).alias("answer")
    )
