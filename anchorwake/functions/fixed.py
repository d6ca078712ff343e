"""The event names, labels and weights of the play-by-play model.

They are part of the results (report labels, weights in a score), so they are
stated literally and kept in one place.
"""

# Event names and outcomes in the log.
ANCHOR_EVENT = "faceoff"
SHOT_EVENT = "shot"
GOAL_EVENT = "goal"
ATTEMPT_EVENTS = (SHOT_EVENT, GOAL_EVENT)
WON = "successful"
LOST = "failed"
EVEN_STRENGTH = "evenStrength"

# Five zones by x in the acting team's attacking view (x above the bound).
ZONE5_STEPS = (
    (25, "1. Offensiv Zon"),
    (5, "2. Neutral Zon (Off)"),
    (-5, "3. Mitt-tekning"),
    (-25, "4. Neutral Zon (Def)"),
)
ZONE5_REST = "5. Defensiv Zon"
ATTACKING_ZONES = ("1. Offensiv Zon", "2. Neutral Zon (Off)")
DEFENDING_ZONES = ("4. Neutral Zon (Def)", "5. Defensiv Zon")
ATTACKING_ROLE = "Anfallande Lag"
DEFENDING_ROLE = "Försvarande Lag"

# Three zone types by distance from the centre line.
ZONE_TYPE_STEPS = ((25, "Endzone"), (5, "Neutral_Side"))
ZONE_TYPE_REST = "Center"

# Winner's zone, start zone, and integer zone level.
OFFENSIVE, NEUTRAL, DEFENSIVE = "Offensive Zone", "Neutral Zone", "Defensive Zone"
WINNER_ZONE_STEPS = ((25, OFFENSIVE), (-25, NEUTRAL))
WINNER_ZONE_REST = DEFENSIVE
START_ZONE_STEPS = ((25, "Offensive Zone"), (5, "Neutral Zone"))
START_ZONE_REST = "Center Ice"
ZONE_LEVEL_STEPS = ((25, 2), (5, 1), (-5, 0), (-25, -1))
ZONE_LEVEL_REST = -2

# Where a sequence ended.
MOVED_OFFENSIVE, MOVED_MIDDLE, MOVED_DEFENSIVE = "Offensiv Zon", "Mittzon", "Defensiv Zon"

# Outcome labels: event kinds in order of priority, then possession by zone.
GOAL_FOR = "01. Mål (Egna)"
GOAL_AGAINST = "11. Mål (Insläppt)"
SHOT_FOR = "02. Avslut på mål (Egna)"
SHOT_AGAINST = "10. Avslut på mål (Emot)"
ATTEMPT_FOR = "03. Skottförsök (Egna - Miss/Block)"
ATTEMPT_AGAINST = "09. Skottförsök (Emot - Miss/Block)"
POSSESSION_LABELS = (
    # movement, label with the puck, label without it
    (MOVED_OFFENSIVE, "04. Innehav i Offensiv Zon", "05. Utan puck i Offensiv Zon"),
    (MOVED_MIDDLE, "06. Innehav i Mittzon", "07. Utan puck i Mittzon"),
    (MOVED_DEFENSIVE, "08. Innehav i Defensiv Zon", "09. Utan puck i Defensiv Zon"),
)
UNDEFINED_OUTCOME = "12. Odefinierat"

# Leverage weights. Period 4 stands for overtime.
PERIOD_WEIGHTS = {1: 0.6, 2: 0.8, 3: 1.0, 4: 1.5}
OVERTIME_PERIOD = 4
STRENGTH_WEIGHTS = {"evenStrength": 1.0, "powerPlay": 1.3, "shortHanded": 1.3}
UNEVEN_WEIGHT = 1.3
ZONE_TYPE_WEIGHTS = {"Endzone": 1.3, "Neutral_Side": 1.1}
END_ZONE_X = 25
END_ZONE_WEIGHT = 1.3
DEFAULT_WEIGHT = 1.0

# Ratings.
HIGH_HIGH = "High win% + High FIS"
HIGH_LOW = "High win% + Low FIS"
LOW_HIGH = "Low win% + High FIS"
LOW_LOW = "Low win% + Low FIS"

# Job defaults.
HORIZON_SECONDS = 10
MIN_PER_ZONE = {OFFENSIVE: 15, NEUTRAL: 15, DEFENSIVE: 15}
PANEL_SIZE = 10
MIN_RATED = 50
PRIOR_ALPHA, PRIOR_BETA = 10, 10
TERRITORY_SCALE = 0.002
REACH_FLOOR = -100.0
OUTLIER_QUANTILE = 0.92
MIN_ANNOTATED = 0.001

# Texts that count as missing when a CSV file is read the pandas way.
PANDAS_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
