"""Fixed values that results depend on. They are data, not logic."""

# Sampling weights that a collector may send; rows with another weight are invalid.
VALID_WEIGHTS = (1, 10, 20, 100, 1000)

# Host names made of these characters only are valid.
VALID_HOSTNAME = r"^[a-zA-Z0-9_\-./]*$"
IPV4_HOSTNAME = r"^\d+\.\d+\.\d+\.\d+$"

# Upper limit of "good" and lower limit of "bad" per vital.
VITAL_LIMITS = {
    "lcp": (2500, 4000),
    "fid": (100, 300),
    "inp": (200, 500),
    "cls": (0.1, 0.25),
    "ttfb": (800, 1800),
}

# Host suffixes that are left out of traffic reports: previews, editors, third parties.
EXCLUDED_SUFFIXES_PIVOT = (
    ".hlx.page", ".hlx3.page", ".hlx.live", ".helix3.dev", ".sharepoint.com", ".google.com",
    ".edison.pfizer", ".web.pfizer",
)
EXCLUDED_SUFFIXES_DOMAINS = (
    ".hlx.page", ".hlx3.page", ".hlx.live", ".helix3.dev", ".sharepoint.com", ".google.com",
)
EXCLUDED_SUFFIXES_CONTENT = (
    ".hlx.page", ".hlx3.page", ".hlx.live", ".helix3.dev", ".sharepoint.com", ".aem.page", ".aem.live",
)
EXCLUDED_SUFFIXES_GOLIVE = (
    ".hlx.live", ".hlx.page", ".aem.live", ".aem.page", ".pfizer", ".adobeaemcloud.com",
)
EXCLUDED_SUFFIXES_REFERERS = (".hlx3.page", ".hlx.live")
READMITTED_HOST = "www.hlx.live"
# Collector hosts with this suffix count for go-live hints only when they are the site itself.
GOLIVE_COLLECTOR_SUFFIX = "adobeaemcloud.net"
# Infix of host names that get no experience score.
UNSCORED_HOST_INFIX = ".hlx."
# Host infix of branch previews in the owner/repo filter.
PREVIEW_INFIX = ".hlx"

# Coefficients of the Abramowitz-Stegun error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# z-score of the 95 % confidence level.
Z_95 = 1.96

# Hours that one unit of forecast progress stands for.
FORECAST_HOURS = 24 * 24

# Sources and urls that are no billable requests.
EXCLUDED_URL_PARTS = ("/libs/",)
EXCLUDED_URL_SUFFIXES = ("/manifest.json",)
EXCLUDED_SOURCE_PARTS = ("/api/qraphql/", "/libs/", "/manifest.json")

# Status text of the audit job.
AUDIT_STORED = "Lighthouse Data Successfully Uploaded"

# Size limit of one delivered result, in bytes.
DELIVERY_BYTES = 1024 * 1024 * 6 * 0.8
