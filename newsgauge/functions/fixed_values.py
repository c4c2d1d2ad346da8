"""Fixed values.

Word lists, lookup tables and constants that results depend on. They are data, kept together
and in plain text; every function that uses them also accepts the caller's own.
"""

# Sentiment lexicon, term -> weight.
POSITIVE_TERMS = {
    "approval": 1.4, "approved": 1.4, "beat": 1.2, "beats": 1.2, "benefit": 0.9, "boost": 1.0,
    "bullish": 1.2, "cuts rates": 1.1, "deal": 0.7, "eases": 0.9, "expands": 0.8, "gain": 0.8,
    "gains": 0.8, "growth": 0.9, "higher": 0.7, "incentive": 1.0, "infrastructure": 0.7,
    "investment": 0.8, "launch": 0.6, "profit": 0.9, "raises guidance": 1.4, "record": 1.1,
    "relief": 0.8, "rises": 0.8, "subsidy": 1.0, "surge": 1.1, "tax credit": 1.0, "upgrade": 1.1,
    "wins": 0.9,
}

NEGATIVE_TERMS = {
    "antitrust": 1.1, "ban": 1.3, "bearish": 1.2, "charges": 1.1, "crackdown": 1.3,
    "cuts guidance": 1.4, "decline": 0.9, "delay": 0.7, "drops": 0.9, "export controls": 1.4,
    "falls": 0.8, "fine": 0.9, "fraud": 1.4, "higher rates": 1.1, "investigation": 1.0,
    "lawsuit": 1.1, "loss": 0.9, "miss": 1.1, "misses": 1.1, "probe": 1.0, "recall": 1.2,
    "recession": 1.3, "regulation": 0.7, "risk": 0.7, "sanction": 1.2, "sanctions": 1.2,
    "slump": 1.1, "tariff": 1.1, "tariffs": 1.1, "warning": 0.9,
}

# Source names by tier; anything else is tier 3.
TIER_1_SOURCES = [
    "reuters", "bloomberg", "wsj", "wall street journal", "financial times", "ft", "cnbc",
    "associated press", "ap", "federal reserve", "sec", "u.s. treasury", "treasury", "white house",
]
TIER_2_SOURCES = [
    "marketwatch", "seeking alpha", "benzinga", "yahoo finance", "nasdaq", "motley fool",
    "investopedia", "google news",
]

# Wording that marks a policy text as helping or hindering.
SUPPORTIVE_POLICY_WORDS = [
    "approval", "approved", "incentive", "subsidy", "tax credit", "permit", "permitting reform",
    "funding", "grant", "contract", "relief", "deregulation", "rate cut", "lower rates",
    "investment",
]
RESTRICTIVE_POLICY_WORDS = [
    "ban", "blocked", "lawsuit", "probe", "investigation", "fine", "tariff", "sanction",
    "export control", "restriction", "cap", "price negotiation", "higher capital", "rate hike",
    "emissions limit",
]

# Industry -> tickers a policy topic spreads to.
INDUSTRY_TICKERS = {
    "semiconductors": ["NVDA", "AMD", "AVGO", "QCOM", "TXN", "AMAT", "LRCX", "MU"],
    "big_tech": ["AAPL", "MSFT", "GOOGL", "GOOG", "META", "AMZN", "ORCL", "CRM", "ADBE", "INTU",
                 "NOW", "IBM"],
    "cybersecurity": ["PANW"],
    "banks_payments": ["JPM", "BAC", "WFC", "C", "GS", "MS", "SCHW", "AXP", "V", "MA", "FI"],
    "canadian_banks": ["RY", "TD", "BMO", "BNS", "CM"],
    "energy": ["XOM", "CVX", "COP", "CNQ", "SU"],
    "pipelines": ["ENB", "TRP"],
    "healthcare_pharma": ["LLY", "JNJ", "ABBV", "MRK", "ABT", "AMGN", "TMO", "DHR", "ISRG", "UNH",
                          "ELV", "PFE", "VRTX"],
    "consumer_retail": ["WMT", "COST", "HD", "LOW", "KO", "PEP", "PG", "MCD", "SBUX", "PM", "NKE",
                        "ATD"],
    "transport_industrials": ["UBER", "CAT", "GE", "BA", "RTX", "HON", "ETN", "LIN", "UNP", "CP",
                              "CNR", "UPS"],
    "aerospace_defense": ["BA", "RTX", "HON", "GE"],
    "electrification_grid": ["ETN", "GE", "LIN", "NEE"],
    "media_entertainment": ["NFLX", "DIS", "CMCSA"],
    "telecom": ["VZ", "T", "BCE", "CSCO", "ANET"],
    "electric_vehicles": ["TSLA"],
    "travel": ["BKNG"],
    "real_estate_logistics": ["PLD"],
    "asset_management_insurance": ["BLK", "SPGI", "BRK.B", "IFC", "MFC"],
    "payments_networks": ["V", "MA", "FI", "AXP"],
    "managed_care": ["UNH", "ELV"],
    "ecommerce": ["AMZN", "SHOP"],
}

# Policy topic, industry it belongs to, keywords that mark it.
POLICY_TOPICS = [
    ("semiconductor_export_controls", "semiconductors",
     ["semiconductor", "chip", "chips act", "export control", "advanced computing"]),
    ("big_tech_antitrust_regulation", "big_tech",
     ["antitrust", "big tech", "technology regulation", "app store", "platform", "privacy rule",
      "data protection"]),
    ("banking_regulation_rates", "banks_payments",
     ["federal reserve", "interest rate", "bank capital", "stress test", "basel"]),
    ("payments_interchange_regulation", "payments_networks",
     ["interchange", "credit card competition", "payment network", "card fees", "debit routing"]),
    ("canadian_bank_regulation_rates", "canadian_banks",
     ["bank of canada", "osfi", "capital buffer", "mortgage", "interest rate"]),
    ("energy_policy_oil_gas", "energy",
     ["oil", "gas", "drilling", "pipeline", "lng", "energy policy", "emissions"]),
    ("ai_power_grid_permitting", "electrification_grid",
     ["data center", "grid", "transmission", "power demand", "electricity demand",
      "permitting reform"]),
    ("pipeline_permitting_policy", "pipelines",
     ["pipeline", "permitting", "energy infrastructure", "transmission"]),
    ("drug_pricing_healthcare_policy", "healthcare_pharma",
     ["drug pricing", "fda", "medicare", "healthcare policy", "clinical trial"]),
    ("managed_care_medicare_policy", "managed_care",
     ["medicare advantage", "managed care", "rate notice", "cms", "health insurer"]),
    ("consumer_tariffs_retail_policy", "consumer_retail",
     ["tariff", "consumer price", "retail", "minimum wage", "food inflation"]),
    ("labor_wage_consumer_policy", "consumer_retail",
     ["minimum wage", "overtime rule", "labor rule", "union", "worker classification"]),
    ("infrastructure_transport_policy", "transport_industrials",
     ["infrastructure", "transportation", "rail", "aerospace", "defense", "supply chain"]),
    ("defense_procurement_budget", "aerospace_defense",
     ["defense budget", "defense procurement", "missile", "fighter jet", "aerospace contract"]),
    ("ev_tax_credits_emissions_policy", "electric_vehicles",
     ["ev tax credit", "electric vehicle", "emissions", "battery", "clean vehicle"]),
    ("cybersecurity_policy", "cybersecurity",
     ["cybersecurity", "ransomware", "critical infrastructure", "data breach"]),
    ("ai_export_controls_cloud", "big_tech",
     ["ai export", "cloud restriction", "advanced ai", "compute rule", "model weights"]),
    ("telecom_spectrum_policy", "telecom",
     ["spectrum", "telecom", "broadband", "net neutrality", "fcc"]),
    ("travel_border_policy", "travel",
     ["travel", "visa", "tourism", "border", "airline"]),
    ("real_estate_rates_logistics", "real_estate_logistics",
     ["commercial real estate", "warehouse", "industrial property", "rates"]),
    ("insurance_climate_capital_rules", "asset_management_insurance",
     ["insurance", "climate risk", "catastrophe", "capital rule", "reinsurance"]),
    ("ecommerce_marketplace_rules", "ecommerce",
     ["online marketplace", "ecommerce", "seller fees", "marketplace rule", "digital services"]),
]

# Ticker -> company name used in text matching and displays.
COMPANY_NAMES = {
    "NVDA": "Nvidia", "AAPL": "Apple", "MSFT": "Microsoft", "AMZN": "Amazon", "GOOGL": "Alphabet",
    "GOOG": "Alphabet", "META": "Meta", "TSLA": "Tesla", "BRK.B": "Berkshire Hathaway",
    "JPM": "JPMorgan", "LLY": "Eli Lilly", "V": "Visa", "NFLX": "Netflix", "MA": "Mastercard",
    "XOM": "Exxon Mobil", "WMT": "Walmart", "COST": "Costco", "JNJ": "Johnson & Johnson",
    "PG": "Procter Gamble", "HD": "Home Depot", "ABBV": "AbbVie", "BAC": "Bank of America",
    "ORCL": "Oracle", "KO": "Coca-Cola", "PM": "Philip Morris", "GE": "GE", "CSCO": "Cisco",
    "CRM": "Salesforce", "CVX": "Chevron", "WFC": "Wells Fargo", "ABT": "Abbott", "IBM": "IBM",
    "MCD": "McDonald's", "AMD": "AMD", "LIN": "Linde", "MRK": "Merck", "TMO": "Thermo Fisher",
    "DIS": "Disney", "PEP": "PepsiCo", "NOW": "ServiceNow", "ACN": "Accenture",
    "ISRG": "Intuitive Surgical", "QCOM": "Qualcomm", "INTU": "Intuit", "UBER": "Uber",
    "VZ": "Verizon", "TXN": "Texas Instruments", "CAT": "Caterpillar", "AMGN": "Amgen",
    "AVGO": "Broadcom", "ADBE": "Adobe", "AMAT": "Applied Materials", "ANET": "Arista Networks",
    "AXP": "American Express", "BA": "Boeing", "BKNG": "Booking Holdings", "BLK": "BlackRock",
    "C": "Citigroup", "CMCSA": "Comcast", "COP": "ConocoPhillips", "DHR": "Danaher",
    "ELV": "Elevance Health", "ETN": "Eaton", "FI": "Fiserv", "GS": "Goldman Sachs",
    "HON": "Honeywell", "LOW": "Lowe's", "LRCX": "Lam Research", "MS": "Morgan Stanley",
    "MU": "Micron", "NEE": "NextEra Energy", "NKE": "Nike", "PANW": "Palo Alto Networks",
    "PFE": "Pfizer", "PLD": "Prologis", "RTX": "RTX", "SBUX": "Starbucks",
    "SCHW": "Charles Schwab", "SPGI": "S&P Global", "T": "AT&T", "UNH": "UnitedHealth",
    "UNP": "Union Pacific", "UPS": "UPS", "VRTX": "Vertex Pharmaceuticals", "SHOP": "Shopify",
    "RY": "Royal Bank of Canada", "TD": "Toronto-Dominion Bank", "BMO": "Bank of Montreal",
    "BNS": "Bank of Nova Scotia", "CM": "Canadian Imperial Bank of Commerce",
    "CNQ": "Canadian Natural Resources", "ENB": "Enbridge", "TRP": "TC Energy",
    "SU": "Suncor Energy", "BCE": "BCE", "CP": "Canadian Pacific Kansas City",
    "CNR": "Canadian National Railway", "ATD": "Alimentation Couche-Tard",
    "IFC": "Intact Financial", "MFC": "Manulife",
}

# Ticker -> sector.
SECTORS = {
    "NVDA": "semiconductors", "AMD": "semiconductors", "AVGO": "semiconductors",
    "QCOM": "semiconductors", "TXN": "semiconductors", "AMAT": "semiconductors",
    "LRCX": "semiconductors", "MU": "semiconductors", "AAPL": "big_tech", "MSFT": "big_tech",
    "GOOGL": "big_tech", "GOOG": "big_tech", "META": "big_tech", "AMZN": "big_tech",
    "ORCL": "big_tech", "CRM": "big_tech", "NOW": "big_tech", "ADBE": "big_tech",
    "INTU": "big_tech", "IBM": "big_tech", "PANW": "cybersecurity", "ANET": "networking",
    "CSCO": "networking", "JPM": "banks_payments", "BAC": "banks_payments",
    "WFC": "banks_payments", "C": "banks_payments", "GS": "banks_payments",
    "MS": "banks_payments", "SCHW": "banks_payments", "BLK": "asset_management",
    "AXP": "banks_payments", "V": "banks_payments", "MA": "banks_payments",
    "FI": "banks_payments", "SPGI": "market_data", "RY": "canadian_banks",
    "TD": "canadian_banks", "BMO": "canadian_banks", "BNS": "canadian_banks",
    "CM": "canadian_banks", "XOM": "energy", "CVX": "energy", "COP": "energy", "CNQ": "energy",
    "ENB": "pipelines", "TRP": "pipelines", "SU": "energy", "LLY": "healthcare_pharma",
    "JNJ": "healthcare_pharma", "ABBV": "healthcare_pharma", "MRK": "healthcare_pharma",
    "ABT": "healthcare_pharma", "AMGN": "healthcare_pharma", "TMO": "healthcare_tools",
    "DHR": "healthcare_tools", "ISRG": "medical_devices", "UNH": "managed_care",
    "ELV": "managed_care", "PFE": "healthcare_pharma", "VRTX": "healthcare_pharma",
    "WMT": "consumer_retail", "COST": "consumer_retail", "HD": "consumer_retail",
    "LOW": "consumer_retail", "KO": "consumer_staples", "PEP": "consumer_staples",
    "PG": "consumer_staples", "MCD": "restaurants", "SBUX": "restaurants",
    "PM": "consumer_staples", "NKE": "apparel", "ATD": "consumer_retail",
    "UBER": "transport_industrials", "CAT": "transport_industrials",
    "GE": "aerospace_industrials", "BA": "aerospace_industrials", "RTX": "aerospace_defense",
    "HON": "aerospace_industrials", "ETN": "electrification", "LIN": "chemicals",
    "UNP": "rails_logistics", "CP": "rails_logistics", "CNR": "rails_logistics",
    "UPS": "logistics", "NFLX": "media_entertainment", "DIS": "media_entertainment",
    "CMCSA": "media_entertainment", "VZ": "telecom", "T": "telecom", "BCE": "telecom",
    "TSLA": "electric_vehicles", "NEE": "utilities_renewables", "PLD": "real_estate_logistics",
    "BKNG": "travel", "SHOP": "ecommerce", "ACN": "consulting_it_services",
    "BRK.B": "diversified_financials", "IFC": "insurance", "MFC": "insurance",
}

# Tickers spelled differently at quote providers, and those without a real quote.
SYMBOL_OVERRIDES = {"BRK.B": "BRK-B", "CNR": "CNI", "CP": "CP", "FI": "FISV"}
SYNTHETIC_ONLY_TICKERS = ["ATD", "IFC"]
PROVIDER_ORDER = ["polygon", "alpha_vantage", "yahoo_chart", "stooq"]
# Days a provider is asked to look back; None when it returns its whole recent series.
PROVIDER_MAX_AGE = {"polygon": 45, "alpha_vantage": None, "yahoo_chart": 45, "stooq": 10}

# Alert types a refresh resolves before new ones are raised.
MONITORED_ALERTS = [
    "low_headline_coverage", "low_insight_coverage", "high_synthetic_quote_usage",
    "portfolio_equity_invalid", "pipeline_failed", "pipeline_never_finished", "pipeline_stale",
]
