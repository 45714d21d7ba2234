"""Word lists, thresholds and lookup tables the results depend on."""

# Seller cities that are not cities.
INVALID_SELLER_CITIES = [
    "04482255",
    "vendas@creditparts.com.br",
    "rio de janeiro / rio de janeiro",
    "sao paulo / sao paulo",
    "rio de janeiro \\rio de janeiro",
    "ribeirao preto / sao paulo",
    "sp",
    "carapicuiba / sao paulo",
    "mogi das cruzes / sp",
    "sp / sp",
    "auriflama/sp",
    "pinhais/pr",
    "cariacica / es",
    "jacarei / sao paulo",
    "sao sebastiao da grama/sp",
    "maua/sao paulo",
    " ",
    "lages - sc",
]

# The states reported by the territory analysis.
STATES = [
    "RJ", "SP", "MG", "PE", "PR", "SC", "GO", "RR", "MT", "RS", "PI", "BA", "ES", "AL",
    "DF", "SE", "AM", "MA", "CE", "PA", "TO", "MS", "RO", "PB", "RN", "AC", "AP",
]

# Upper categories with their English product categories.
CATEGORY_TREE = {
    "health_beauty": ["health_beauty", "perfumery", "diapers_and_hygiene"],
    "electronics_technology": [
        "computers_accessories", "telephony", "tablets_printing_image", "fixed_telephony",
        "consoles_games", "audio", "electronics", "small_appliances", "home_appliances",
        "home_appliances_2", "small_appliances_home_oven_and_coffee", "cine_photo",
        "cds_dvds_musicals", "dvds_blu_ray", "computers",
    ],
    "automotive": ["auto"],
    "home_furniture_decor": [
        "bed_bath_table", "furniture_decor", "kitchen_dining_laundry_garden_furniture",
        "furniture_mattress_and_upholstery", "furniture_living_room", "furniture_bedroom",
        "office_furniture", "home_confort", "home_comfort_2", "home_construction", "la_cuisine",
        "air_conditioning",
    ],
    "fashion_accessories": [
        "fashion_bags_accessories", "fashion_shoes", "fashion_male_clothing",
        "fashio_female_clothing", "fashion_underwear_beach", "fashion_sport",
        "luggage_accessories", "watches_gifts", "sports_leisure",
    ],
    "construction_industry": [
        "construction_tools_construction", "costruction_tools_garden", "costruction_tools_tools",
        "construction_tools_lights", "construction_tools_safety", "industry_commerce_and_business",
        "agro_industry_and_commerce", "signaling_and_security", "security_and_services",
    ],
    "food_drinks": ["food_drink", "drinks", "food", "party_supplies"],
    "baby_kids": ["baby", "toys", "fashion_childrens_clothes"],
    "books": ["books_technical", "books_general_interest", "books_imported"],
    "art": ["music", "art", "arts_and_craftmanship", "stationery", "musical_instruments"],
    "home_lifestyle_misc": [
        "garden_tools", "flowers", "cool_stuff", "market_place", "christmas_supplies", "housewares",
    ],
    "pets": ["pet_shop"],
}
MISSING_CATEGORY = "miss"

# Seconds since the last purchase and the share of repeat purchases made by then.
REPEAT_SECONDS = [
    0.0, 1.0, 2.0, 4.0, 854.0, 62913.0, 263666.0, 601013.0, 874461.0, 1250767.0, 1726669.0,
    2208353.0, 2846709.0, 3540412.0, 4215159.0, 4981450.0, 5928244.0, 7000816.0, 8521546.0,
    9990747.0, 11526042.0, 13391879.0, 15495376.0, 17551140.0, 20507899.0, 24266941.0, 29184041.0,
    40506639.0,
]
REPEAT_SHARES = [
    0.0, 0.09615384615384616, 0.19230769230769232, 0.22435897435897437, 0.2564102564102564,
    0.28846153846153844, 0.32051282051282054, 0.3525641025641026, 0.38461538461538464,
    0.4166666666666667, 0.44871794871794873, 0.4807692307692308, 0.5128205128205128,
    0.5448717948717948, 0.5769230769230769, 0.6089743589743589, 0.6410256410256411,
    0.6730769230769231, 0.7051282051282052, 0.7371794871794872, 0.7692307692307693,
    0.8012820512820513, 0.8333333333333334, 0.8653846153846154, 0.8974358974358975,
    0.9294871794871795, 0.9615384615384616, 0.9935897435897436,
]

# Words of the segment descriptions, one list per axis, score 1 to 3.
RECENCY_WORDS = ["Недавние", "Средней давности", "Давние"]
FREQUENCY_WORDS = ["частые", "не очень часто", "редкие"]
MONEY_WORDS = ["высокий чек", "средний чек", "низкий чек"]
UNDEFINED_SEGMENT = "Не определено"

# Column titles of the displayed retention report.
RETENTION_TITLES = [
    "Период", "Клиентов на начало", "Новых клиентов", "Ушедших клиентов", "Клиентов на конец",
    "Retention Rate (%)",
]

# Thresholds.
GONE_AFTER_DAYS = 231
GONE_BELOW = 0.1
COHORT_GRACE_MONTHS = 7
DROPPED_STATUSES = ["unavailable", "canceled"]
