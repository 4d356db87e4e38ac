"""Units, rates and thresholds shared by all operators."""

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32
FLOOR_KM = 0.5
HEAD_MAYER = 0.67
#: Freight cost in dollars an hour, speed in km/h (0: flat rate), and handling hours.
RATE = {"road": 30.0, "maritime": 8.0, "air": 220.0, "transfer": 5.0}
SPEED = {"road": 65.0, "maritime": 24.0, "air": 850.0, "transfer": 0.0}
PORT_HOURS, AIRPORT_HOURS = 24.0, 4.0
MODE_CODE = {"road": 0, "maritime": 1, "air": 2, "transfer": 3}
#: Bits of a sea edge's chokepoints.
SUEZ, PANAMA, RED_SEA, BAB_EL_MANDEB, HORMUZ, MALACCA = 1, 2, 4, 8, 16, 32
SUEZ_CLOSED, PANAMA_SLOW, RED_SEA_RISK = 1e6, 1.8, 2.5
#: Disk curve at theta = -5 and R = 1000 km: floor (km), effective distance (km).
DISK_CURVE = ((0.01, 0.063), (0.1, 0.631), (1.0, 6.288), (5.0, 29.449), (10.0, 51.855), (50.0, 149.742), (100.0, 229.350), (200.0, 352.875), (500.0, 640.413))
THETA_SCALE = {-3.0: 3.25, -5.0: 1.0, -7.0: 0.75}
DISK_RADIUS, DISK_CAP, DISK_CAP_EARLY = 1000.0, 0.9, 0.67
#: Agglomerations: persons a km2, merge distance, coverage, most, least population.
DENSITY, MERGE_KM, COVERAGE, MOST_AGGLOMERATIONS, LEAST_POPULATION = 300.0, 25.0, 0.80, 50, 5000.0
HUB_LIMIT, AIR_RANGE_KM = 250, 15000.0
THOUSAND = 1000.0
