"""Fixed values that results depend on."""

# File types, by lower-cased extension.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "heif", "heic", "gif", "bmp", "tiff", "tif"]
RAW_EXTENSIONS = [
    "raw", "dng", "cr2", "cr3", "nef", "arw", "orf", "raf",
    "rw2", "pef", "srw", "erf", "mrw", "3fr", "fff", "iiq",
]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "m4v", "mkv"]
SUPPORTED_EXTENSIONS = IMAGE_EXTENSIONS + RAW_EXTENSIONS + VIDEO_EXTENSIONS
CONVERTIBLE_EXTENSIONS = ["tif", "tiff", "bmp"]
CAMERA_JPEG_EXTENSIONS = ["jpg", "jpeg", "heic", "heif"]
STILL_EXTENSIONS = ["jpg", "jpeg", "heic", "heif", "png", "dng"]
LIVE_VIDEO_EXTENSIONS = ["mov", "mp4"]
DATED_VIDEO_EXTENSIONS = ["mov", "mp4", "m4v", "3gp"]

# Remote formats that are videos.
VIDEO_FORMATS = [
    "MP4", "MOV", "M4V", "AVI", "MPG", "MPEG", "MTS", "M2TS", "3GP", "WMV", "MKV", "WEBM",
]

# Directories that never hold a person's own photos.
SYSTEM_DIRECTORIES = ["@eaDir", "#recycle", "#snapshot", "$RECYCLE.BIN"]

# How a file was dated.
DATED_BY_EXIF = "photo metadata"
DATED_BY_VIDEO = "video metadata"
DATED_BY_NAME = "file name"
DATED_BY_EXIF_MODIFIED = "photo's last-edited date"
DATED_BY_MTIME = "file modified time"
DATED_BY_LIVE_PHOTO = "Live Photo's photo"

# Earliest believable years, by where a date comes from.
EARLIEST_EXIF_YEAR = 1900
EARLIEST_VIDEO_YEAR = 1971
EARLIEST_NAME_YEAR = 1990
EARLIEST_NAME_EPOCH_YEAR = 2004

# Seconds from 1904-01-01 (QuickTime) to 1970-01-01, and the first year of
# the Unix epoch, before which a movie header's clock was not set.
QUICKTIME_EPOCH_OFFSET = 2_082_844_800
UNSET_CLOCK_SECONDS = 365 * 24 * 3600

# Zone in which the remote catalog reads a camera's clock.
CAMERA_ZONE = "America/Los_Angeles"

# Limits.
ALBUM_CAPACITY = 5000
SERIES_LIMIT = 1000
NAME_CANDIDATES = 1000
COLLECT_BATCH = 100
MAX_VIDEO_MINUTES = 20
MIN_VIDEO_SIDE = 237
SEARCH_LIMIT = 100
RECENT_LIMIT = 20
ERROR_LIMIT = 20
EXAMPLE_LIMIT = 10
BUSY_DAYS = 5
BUSY_DAY_FILES = 500
MAX_NAME_CHARS = 254
MAX_URL_NAME_CHARS = 60
MAX_COMMENT_BYTES = 60000
MAX_COMMENT_FIELD_BYTES = 50
MAX_RATING = 5
# Longest file name a file system stores, in bytes.
FILE_NAME_BYTES = 255

# Answers that will not change until the file does.
PERMANENT_STATUSES = [400, 413, 415, 422]
PERMANENT_CODES = [6, 64, 66, 71, 72]
CODE_UNFINISHED = 64
CODE_TOO_LONG = 71
CODE_TOO_SMALL = 72

# Why a file is refused or fails, as recorded.
REASON_UNFINISHED = "unfinished recording"
REASON_TOO_LONG = "video too long"
REASON_TOO_SMALL = "video too small"
REASON_COPY_FAILED = "an identical file failed to upload"
REASON_SERIES_FULL = "album series is full"
REASON_NO_FREE_NAME = "no free name"
REASON_GONE = "the image is no longer in the catalog"

# Sort settings, by the word a caller uses.
FOLDER_SORTS = {
    "name": "Name", "added": "DateAdded", "modified": "DateModified", "manual": "SortIndex",
}
ALBUM_SORTS = {
    "manual": "Position", "caption": "Caption", "filename": "Filename",
    "uploaded": "Date Uploaded", "modified": "Date Modified", "taken": "Date Taken",
}
DIRECTIONS = {"asc": "Ascending", "desc": "Descending"}

# API path of an image.
IMAGE_URI_PREFIX = "/api/v2/image/"
