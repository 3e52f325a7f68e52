"""The question set: templates, sampled parameter values, and their ground truth."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velobus.plans import questions as q
from velobus.sources.tables import AsOf, within

SAMPLE_SIZE = 20

# Fixed values: (key, parameter, horizon, question text).
TEMPLATES = [
    (
        "q1_bike_station_cluster_status", "station_name", "hours",
        "Dla stacji rowerowej o nazwie '{station_name}', jaka jest jej predykcja klasteryzacji (cluster_id) dla ostatniego zapisu danych, i czy model uznał tę predykcję za udaną (cluster_prediction_success)? Czy w tym samym czasie występowały silne opady deszczu (precip_mm > 0)? Jeśli nie masz danych dla stacji '{station_name}', odpowiedz: 'Brak danych dla tej stacji'.",
    ),
    (
        "q2_bus_cluster_delay_category", "cluster_id", "hours",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Ile autobusów należało do klastra o id '{cluster_id}' w ciągu ostatnich {time_interval_hours} godzin i jaka była ich dominująca kategoria opóźnienia (delay_category_label)? Jeśli nie masz danych dla klastra o id '{cluster_id}', odpowiedz: 'Brak danych dla tego klastra'.",
    ),
    (
        "q3_avg_electric_bikes_success_binary", "", "hours",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Dla wszystkich predykcji bike_binary_prediction_success o wartości PRAWDA w ciągu ostatnich {time_interval_hours} godzin, jaka jest średnia liczba dostępnych rowerów elektrycznych (electric_bikes_available)? Jeśli nie ma dostępnych danych, odpowiedz: 'Brak danych do obliczenia średniej'.",
    ),
    (
        "q4_most_common_delay_label_success", "", "hours",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Jaka jest najczęściej występująca etykieta opóźnienia (delay_category_label) dla autobusów, dla których predykcja sukcesu opóźnienia (delay_category_prediction_success) była pomyślna w ciągu ostatnich {time_interval_hours} godzin, i jaka jest średnia wartość on_time_stop_ratio dla tych autobusów? Jeśli nie ma dostępnych danych, odpowiedz: 'Brak danych do obliczenia statystyk'.",
    ),
    (
        "q5_weather_low_bike_availability_cluster", "cluster_id", "hours",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. W jakich warunkach pogodowych (weather_condition) stacje rowerowe o cluster_id równym '{cluster_id}' najczęściej miały niską dostępność rowerów (bikes_available < 5) w ciągu ostatnich {time_interval_hours} godzin? Jeśli nie masz danych dla klastra o id '{cluster_id}', odpowiedz: 'Brak danych dla tego klastra'.",
    ),
    (
        "q6_bus_pm25_delay_correlation", "bus_line_number", "hours",
        "Czy zaobserwowano, że w przypadku autobusów linii '{bus_line_number}', dla których predykcja opóźnienia była pomyślna (delay_category_prediction_success = TRUE), średnie stężenie PM2.5 było wyższe niż w przypadku niepomyślnych predykcji w ciągu ostatnich {time_interval_hours} godzin? Podaj średnie wartości PM2.5 dla obu grup (pomyślnych i niepomyślnych predykcji).",
    ),
    (
        "q7_humidity_temp_bike_prediction_impact", "station_name", "hours",
        "Opisz, jak wilgotność (humidity) i temperatura (temperature) wpływają na prognozowaną liczbę dostępnych rowerów (bike_regression_prediction) dla stacji '{station_name}' w ciągu ostatnich {time_interval_hours} godzin. Jeśli nie masz danych dla stacji o nazwie '{station_name}', odpowiedz: 'Brak danych dla tej stacji'.",
    ),
    (
        "q8_visibility_very_late_buses", "bus_line_number", "hours",
        "W jakich warunkach widoczności (visibility_km) autobusy linii '{bus_line_number}' najczęściej doświadczały opóźnień sklasyfikowanych jako 'bardzo spóźniony' (delay_category_label = 'bardzo spóźniony') w ciągu ostatnich {time_interval_hours} godzin? Jeśli nie masz danych dla linii autobusowej '{bus_line_number}', odpowiedz: 'Brak danych dla tej linii'.",
    ),
    (
        "q9_uv_bikes_bus_delay_correlation", "cluster_id", "days",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Czy istnieje trend, że w dniach o wysokim wskaźniku UV (uv_index > 7) stacje rowerowe w klastrze '{cluster_id}' mają większą liczbę dostępnych rowerów manualnych (manual_bikes_available) niż elektrycznych w ciągu ostatnich {time_interval_days} dni? I czy wpływa to na średnie opóźnienie autobusów (average_delay_seconds) w sąsiadujących obszarach (dla tego samego dnia i podobnych warunków pogodowych)? Jeśli nie masz danych dla klastra o id '{cluster_id}', odpowiedz: 'Brak danych dla tego klastra'.",
    ),
    (
        "q10_optimal_hours_bikes_buses", "", "days",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. W jakich godzinach dobowych (timestamp - godziny), przy niskim zachmurzeniu (cloud < 20), występuje jednocześnie największa dostępność rowerów (bikes_available) i najkrótsze średnie opóźnienia autobusów (average_delay_seconds) w ciągu ostatnich {time_interval_days} dni? Jeśli nie ma dostępnych danych, odpowiedz: 'Brak danych do analizy'.",
    ),
    (
        "q11_top_environmental_factors_bus_delay_success", "", "days",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Jakie są trzy główne czynniki środowiskowe (pogoda/zanieczyszczenia), które najbardziej wpływają na prognozowany sukces klasyfikacji opóźnień autobusów (delay_category_prediction_success) w ciągu ostatnich {time_interval_days} dni? Jeśli nie ma dostępnych danych, odpowiedz: 'Brak danych do analizy.'.",
    ),
    (
        "q12_cluster_success_comparison_temp", "", "days",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Porównaj sukces predykcji klasteryzacji (cluster_prediction_success) dla stacji rowerowych i linii autobusowych w ciągu ostatnich {time_interval_days} dni. Który sektor wykazał wyższy wskaźnik sukcesu i jaka była średnia temperatura (temperature) w tych pomyślnych predykcjach dla każdego sektora? Jeśli nie ma dostępnych danych, odpowiedz: 'Brak danych do analizy.'.",
    ),
    (
        "q13_bike_station_needs_refill", "", "hours",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Bazując na danych o klastrach stacji rowerowych i prognozach dostępności (bike_regression_prediction), wskaż stację, która w ciągu ostatnich {time_interval_hours} godzin najprawdopodobniej wymagała uzupełnienia rowerów, biorąc pod uwagę bieżące warunki pogodowe (np. bikes_available < 5 i weather_condition jest niesprzyjający). Jeśli nie ma dostępnych danych, odpowiedz: 'Brak danych do analizy.'.",
    ),
    (
        "q14_bus_routes_high_delay_heavy_rain", "", "days",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Które trasy autobusowe (bus_line_number) są najbardziej podatne na duże opóźnienia (average_delay_seconds > 300 sekund) w dniach o dużym opadzie deszczu (precip_mm > 5), zgodnie z klasyfikacjami ML w ciągu ostatnich {time_interval_days} dni? Jeśli nie ma dostępnych danych, odpowiedz: 'Brak danych do analizy.'.",
    ),
    (
        "q15_pollution_bike_rental_correlation", "", "days",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Czy istnieje wzorzec, w którym wzrost zanieczyszczeń powietrza (np. fine_particles_pm2_5) koreluje ze spadkiem liczby wypożyczeń rowerów (wzrost docks_available)? Jakie są średnie stężenia PM2.5 w dniach, gdy docks_available rosło gwałtownie w ciągu ostatnich {time_interval_days} dni? Jeśli nie ma dostępnych danych, odpowiedz: 'Brak danych do analizy.'.",
    ),
    (
        "q16_optimization_strategies_summary", "", "days",
        "Pamiętaj, aby uwzględnić wszystkie dostępne dane. Jakie strategie optymalizacji tras autobusowych lub rozmieszczenia rowerów miejskich można by zasugerować, bazując na analizie sukcesu predykcji klasteryzacji i klasyfikacji ML oraz wpływie warunków pogodowych na opóźnienia i dostępność, w oparciu o dane z ostatnich {time_interval_days} dni? Podaj ogólne wnioski. Jeśli nie ma dostępnych danych, odpowiedz: 'Brak danych do analizy.'.",
    ),
]

# The answer when a parameter value has no rows in the horizon.
NO_DATA = {
    "q1_bike_station_cluster_status": "Brak danych dla stacji rowerowej '{value}' w ciągu ostatnich {n} godzin.",
    "q2_bus_cluster_delay_category": "Brak danych dla klastra o id '{value}' w ciągu ostatnich {n} godzin.",
    "q4_most_common_delay_label_success": "Brak danych o pomyślnych predykcjach opóźnień autobusów w ciągu ostatnich {n} godzin.",
    "q5_weather_low_bike_availability_cluster": "Brak danych dla klastra o id '{value}' z niską dostępnością rowerów w ciągu ostatnich {n} godzin.",
    "q6_bus_pm25_delay_correlation": "Brak danych dla linii autobusowej '{value}' w ciągu ostatnich {n} godzin.",
    "q7_humidity_temp_bike_prediction_impact": "Brak wystarczających danych dla stacji '{value}' w ciągu ostatnich {n} godzin do analizy wpływu wilgotności i temperatury.",
    "q8_visibility_very_late_buses": "Brak danych o opóźnieniach 'bardzo spóźniony' dla linii '{value}' w ciągu ostatnich {n} godzin.",
    "q9_uv_bikes_bus_delay_correlation": "Brak wystarczających danych dla analizy korelacji UV, rowerów i opóźnień autobusów w ciągu ostatnich {n} dni.",
    "q10_optimal_hours_bikes_buses": "Brak wystarczających danych do analizy optymalnych godzin w ciągu ostatnich {n} dni.",
    "q13_bike_station_needs_refill": "Brak stacji wymagających uzupełnienia rowerów w ciągu ostatnich {n} godzin, spełniających kryteria niskiej dostępności i niesprzyjającej pogody.",
}


def recent_values(
    frame: DataFrame,
    column: str,
    as_of: AsOf = None,
    hours: int = q.HOURS,
    limit: int = SAMPLE_SIZE,
    seed: str = "0",
) -> DataFrame:
    """Up to ``limit`` distinct values seen in the horizon, in md5 order: a repeatable sample."""
    return (
        within(frame, as_of, hours=hours)
        .select(F.col(column).cast("string").alias("value"))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy(F.md5(F.concat(F.lit(seed), F.col("value"))), "value")
        .limit(limit)
    )


def parameter_values(
    bikes: DataFrame,
    buses: DataFrame,
    as_of: AsOf = None,
    hours: int = q.HOURS,
    limit: int = SAMPLE_SIZE,
    seed: str = "0",
) -> DataFrame:
    """(parameter, value): station names, line numbers, and the cluster ids of both sectors."""

    def values(frame: DataFrame, column: str) -> DataFrame:
        return recent_values(frame, column, as_of, hours, limit, seed)

    clusters = values(bikes, "cluster_id").unionByName(values(buses, "cluster_id")).distinct()
    parts = [
        (values(bikes, "name"), "station_name"),
        (values(buses, "bus_line_number"), "bus_line_number"),
        (clusters, "cluster_id"),
    ]
    named = [part.select(F.lit(name).alias("parameter"), "value") for part, name in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


def question_set(
    values: DataFrame, hours: int = q.HOURS, days: int = q.DAYS
) -> DataFrame:
    """One row per template and parameter value with the question text.

    Templates without parameter appear once; templates whose parameter has no value are skipped.
    """
    spark = values.sparkSession
    templates = spark.createDataFrame(
        TEMPLATES, "question_key STRING, parameter STRING, horizon STRING, template STRING"
    )
    free = templates.where("parameter = ''").withColumn("value", F.lit(None).cast("string"))
    bound = templates.where("parameter <> ''").join(values, "parameter")
    every = free.unionByName(bound)
    text = F.col("template")
    for name in ("station_name", "bus_line_number", "cluster_id"):
        mine = F.col("parameter") == name
        text = F.when(mine, F.replace(text, F.lit("{%s}" % name), F.col("value"))).otherwise(text)
    text = F.replace(text, F.lit("{time_interval_hours}"), F.lit(str(hours)))
    text = F.replace(text, F.lit("{time_interval_days}"), F.lit(str(days)))
    return every.select("question_key", "value", text.alias("question_text"))


def ground_truth(
    bikes: DataFrame,
    buses: DataFrame,
    as_of: AsOf = None,
    hours: int = q.HOURS,
    days: int = q.DAYS,
) -> DataFrame:
    """(question_key, value, ground_truth) of all questions for all parameter values."""
    h, d = {"as_of": as_of, "hours": hours}, {"as_of": as_of, "days": days}
    answers = {
        "q1_bike_station_cluster_status": (q.station_cluster_status(bikes, **h), "name"),
        "q2_bus_cluster_delay_category": (q.cluster_delay_category(buses, **h), "cluster_id"),
        "q3_avg_electric_bikes_success_binary": (q.mean_electric_bikes(bikes, **h), None),
        "q4_most_common_delay_label_success": (q.top_delay_label(buses, **h), None),
        "q5_weather_low_bike_availability_cluster": (
            q.low_availability_weather(bikes, **h), "cluster_id",
        ),
        "q6_bus_pm25_delay_correlation": (q.pm25_by_success(buses, **h), "bus_line_number"),
        "q7_humidity_temp_bike_prediction_impact": (q.forecast_correlations(bikes, **h), "name"),
        "q8_visibility_very_late_buses": (q.late_visibility(buses, **h), "bus_line_number"),
        "q9_uv_bikes_bus_delay_correlation": (
            q.high_uv_bikes_and_delay(bikes, buses, **d), "cluster_id",
        ),
        "q10_optimal_hours_bikes_buses": (q.best_hour(bikes, buses, **d), None),
        "q11_top_environmental_factors_bus_delay_success": (
            q.top_factors_answer(q.top_factors(buses, **d)), None,
        ),
        "q12_cluster_success_comparison_temp": (q.sector_success(bikes, buses, **d), None),
        "q13_bike_station_needs_refill": (
            q.station_needing_refill(bikes, as_of=as_of, span=hours), None,
        ),
        "q14_bus_routes_high_delay_heavy_rain": (
            q.rain_delay_lines_answer(q.rain_delay_lines(buses, **d), days), None,
        ),
        "q15_pollution_bike_rental_correlation": (q.pollution_and_docks(bikes, **d), None),
        "q16_optimization_strategies_summary": (q.optimization_summary(bikes, buses, **d), None),
    }
    parts = [
        frame.select(
            F.lit(key).alias("question_key"),
            (F.col(name) if name else F.lit(None)).cast("string").alias("value"),
            F.col("answer").alias("ground_truth"),
        )
        for key, (frame, name) in answers.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def with_ground_truth(
    asked: DataFrame, truth: DataFrame, hours: int = q.HOURS, days: int = q.DAYS
) -> DataFrame:
    """Questions with their truth; a value without rows gets the question's no-data text."""
    horizon = {key: hours if kind == "hours" else days for key, _, kind, _ in TEMPLATES}
    texts = F.create_map(
        *[
            F.lit(x)
            for key, text in NO_DATA.items()
            for x in (key, text.replace("{n}", str(horizon[key])))
        ]
    )
    missing = F.replace(
        F.try_element_at(texts, F.col("question_key")),
        F.lit("{value}"),
        F.coalesce("value", F.lit("")),
    )
    named = truth.select(
        F.col("question_key").alias("_key"), F.col("value").alias("_value"), "ground_truth"
    )
    same = (F.col("question_key") == F.col("_key")) & F.col("value").eqNullSafe(F.col("_value"))
    return asked.join(named, same, "left").select(
        "question_key",
        "value",
        "question_text",
        F.coalesce("ground_truth", missing).alias("ground_truth"),
    )
