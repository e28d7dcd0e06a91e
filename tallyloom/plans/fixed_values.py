"""Codes, names and formats that results depend on, as the sources define them."""

# Metropolitan areas of the study, by their census code, and the code used for the nation.
METRO_CODES = [
    "12420",
    "16980",
    "19100",
    "26420",
    "31080",
    "35620",
    "37980",
    "41860",
    "41940",
    "47900",
]
NATION_ID = "1"

# The metropolitan area studied by industry, and the ones compared by employment.
FOCUS_METRO = "37980"
FOCUS_CITY = "Philadelphia"
FOCUS_PREFIX, NATION_PREFIX = "philly", "us"
EMPLOYMENT_METROS = ["16980", "19100", "35620", "37980"]

# Counties of the focus area.
FOCUS_COUNTIES = [
    "34005",
    "34007",
    "34015",
    "34033",
    "42017",
    "42029",
    "42045",
    "42091",
    "42101",
    "10003",
    "24015",
]

# Survey table: workers 16 and over, and those who work from home.
WORKERS_VARIABLE = "B08006_001"
WFH_VARIABLES = {"wfh": "B08006_017"}

# Supersectors, and the census industry codes of each (inclusive ranges).
SUPERSECTOR_NAMES = {
    "00": "Unknown",
    "10": "Natural Resources and Mining",
    "20": "Construction",
    "30": "Manufacturing",
    "40": "Trade, Transportation, and Utilities",
    "50": "Information",
    "55": "Financial Activities",
    "60": "Professional and Business Services",
    "65": "Education and Health Services",
    "70": "Leisure and Hospitality",
    "80": "Other Services",
    "90": "Government",
}
SUPERSECTOR_RANGES = [
    (0, 0, "00"),
    (170, 490, "10"),
    (570, 690, "40"),
    (770, 770, "20"),
    (1070, 3990, "30"),
    (4070, 5790, "40"),
    (6070, 6390, "40"),
    (6470, 6780, "50"),
    (6870, 7190, "55"),
    (7270, 7790, "60"),
    (7860, 8470, "65"),
    (8561, 8690, "70"),
    (8770, 9290, "80"),
    (9370, 9890, "90"),
]
UNKNOWN_SECTOR = "00"
OFFICE_SECTORS = ["50", "55", "60"]

# Answers to the telework question.
OUT_OF_UNIVERSE = 0
TELEWORKED = 1

# Positions in a 20-character employment series identifier (1-based, inclusive).
SERIES_LAYOUT = [
    ("seas_adj", 3, 3),
    ("state_code", 4, 5),
    ("area_code", 6, 10),
    ("supersector_code", 11, 12),
    ("naics_code", 13, 18),
    ("industry_code", 11, 18),
    ("measure_code", 19, 20),
]
ANNUAL_AVERAGE = "M13"
ALL_INDUSTRIES = "000000"
NOT_ADJUSTED = "U"
ALL_EMPLOYEES = "01"
REPORTED_SUPERSECTORS = ["15", "30", "40", "50", "55", "60", "65", "70", "80", "90"]

# Weeks in the moving average, and the first week reported.
ROLLING_WEEKS = 4
FIRST_WEEK = "2020-04-15"
MEAN_OF_METROS = "10 Metro Avg."

# Weeks compared with telework, and the column names of that table.
COMPARED_WEEKS = ("2022-10-01", "2024-05-31")
OCCUPANCY_NAME = "Office Occupancy"
TELEWORK_NAME = "Telework Rate"
