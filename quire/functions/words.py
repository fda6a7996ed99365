"""Function words of the Latin-script languages that the guess tells apart."""

#: Fixed values.
STOPWORDS = {
    "en": "the and of to in is that it for was with as on be at by this had not are but from or have an they which you were his",
    "fr": "le la les de des et un une à est que qui dans pour pas sur au ce il elle nous vous avec plus mais par son sa ses ne",
    "de": "der die das und ist ein eine zu den mit von nicht auch sich auf für dem des im ich er sie es war als wir aber oder dass",
    "es": "el la los las de y un una que en es por con para su no se lo como más pero sus le ya o este porque cuando muy sin",
    "it": "il la le di e un una che in è per con non si lo come più ma sono anche della nel gli dei alla su da questo sua suo",
    "pt": "o a os as de e um uma que em é por com para não se na no dos das mais mas como ao ou sua seu isso quando muito",
    "nl": "de het een en van is dat op te in niet met zijn voor aan er maar om ook als dan dit naar of door uit over worden heeft wordt",
}
#: Letters and tokens that a guess needs, share of the best language, its lead over the second, sample size.
MIN_LETTERS, MIN_TOKENS, MIN_SHARE, LEAD, SAMPLE_CHARS = 24, 30, 0.06, 1.25, 4000
