"""tellback: do the facts a website tells come back in AI answers?

DataFrame-in / DataFrame-out jobs over crawled pages, site files, engine
responses and delivery logs.
"""
