"""What a path says about a file: fixed values."""

# Endings of documents.
DOC_ENDINGS = ".md .markdown .rst .txt .adoc".split()

# Path parts of tests, fixtures and examples.
TEST_PARTS = (
    "test tests spec specs __tests__ fixture fixtures mock mocks example examples sample samples demo demos benchmark e2e"
).split()
TEST_ENDINGS = "_test.py _test.go .test.js .test.ts .spec.js .spec.ts _spec.rb".split()

# Marks of bundled third-party code.
VENDOR_PARTS = (
    "simplepie phpmailer getid3 sodium_compat random_compat phpseclib codemirror tinymce plupload mediaelement jcrop swfupload "
    "twemoji zxcvbn requests ixr jquery backbone underscore masonry imagesloaded thickbox clipboard hoverintent"
).split()
VENDOR_WITHIN = "text/diff /pomo/ /pear/ simplepie/ phpmailer/ /sodium_compat/ /avif-info".split()
VENDOR_STEMS = "esprima json2 underscore backbone".split()
VENDOR_PREFIXES = (
    "class-ftp class-pop3 class-snoopy class-phpass class-simplepie class-json class-ixr class-smtp class-phpmailer "
    "class-requests class-avif-info"
).split()

# Path stems of analyser code.
TOOL_STEMS = (
    "matcher matchers signature signatures rule rules detector detectors scanner scanners payload payloads sqlmap exploit vuln "
    "security sast linter analyzer analyser waf sanitiz"
).split()

# Words that put a file into the first or second tier of a scan.
FIRST_WORDS = (
    "auth login session token password passwd payment checkout billing credit card stripe paypal admin root privilege "
    "permission rbac acl upload download import export api_key secret key cert user account profile register"
).split()
SECOND_WORDS = (
    "config settings env database db model schema route controller handler view endpoint middleware filter interceptor"
).split()

# Words that put a route into the bucket of a probe; the methods, if any, that it must take.
ROUTE_BUCKETS = {
    "numeric_read": ("GET", "balance wallet stock inventory credit"),
    "consume": ("POST", "pay checkout charge withdraw buy purchase reserve transfer spend"),
    "query": ("GET", "search query find lookup filter"),
    "file": ("", "read file download view fetch load get_file static doc attachment"),
    "login": ("", "login signin auth session token logon"),
    "command": ("", "ping cmd exec run command shell lookup nslookup dns"),
    "template": ("", "render template preview greet hello msg message"),
    "redirect": ("", "go redirect next return out away link url"),
    "fetch": ("", "fetch proxy load import webhook callback"),
    "sensitive": ("", "delete remove admin promote grant reset update transfer settings"),
}
ROUTE_ID = r"<[^>]+>|:\w+|\{[^}]+\}"
