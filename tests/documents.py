"""Documents that take the shapes an audit must get right, in wording of our own."""

PLAIN = """Republic of the Philippines
City of Davao
18th City Council
22nd Regular Session
Series of 2016
ORDINANCE NO. 0116-16
AN ORDINANCE SETTING THE HOURS AND LANES OF NIGHT STALLS AND FOR OTHER PURPOSES
WHEREAS, stalls crowd the lanes at noon;
BE IT ORDAINED by the council:
SECTION 1. Stalls keep within their lines, and the market mas-
ter marks these.
- 2 -
SECTION 2. This takes effect at once.
ENACTED
March 15, 2016
APPROVED: March 22, 2016
"""
AMENDING = """ORDINANCE NO. 0118-16
Series of 2016
AN ORDINANCE AMENDING ORDINANCE NO. 0234-15 AS TO WHERE CARTS MAY WAIT AT BRIDGES
WHEREAS, Ordinance No. 0234-15 was approved on May 5, 2015;
WHEREAS, the roads have changed since;
SECTION 1. Section 4 is hereby amended to read as follows: no one parks at corners.
ENACTED this 5th day of April, 2016.
APPROVED this 12th day of April, 2016.
"""
BARE = """Minutes of a meeting about drainage in the lower district, with a list of those who came and of what they
said about pumps, canals, and the season of rain that floods the streets near the river.
"""
OUT_OF_WINDOW = """ORDINANCE NO. 0230-10
Series of 2010
A notice on fees. It binds all who sell by the road, and all who haul for them, from noon to dusk, on every day.
ENACTED this 1st day of June, 2010.
APPROVED: June 10, 2010.
"""
SIGNED = """ORDINANCE NO. 0301-16
Series of 2016
AN ORDINANCE ON DRAINS
WHEREAS, drains clog;
SECTION 1. Drains are kept open by those who live beside them, and cleaned before the rains begin each year.
ENACTED: June 7, 2016
JUAN DELA CRUZ
CITY MAYOR
stamped June 14, 2016
"""
CUE_BEFORE_BREAK = """ORDINANCE NO. 0512-16, Series of 2016
A rule for boats that follows Ordinance No. 0100-12 as amended.
ENACTED this 9th day of August, 2016, in session assembled with all of its members there.
APPROVED on the 19th day of August, 2016.
"""
ALL = [
    (2016, "Ordinance No. 0116-16.pdf", PLAIN), (2016, "Ordinance No. 0116-16 (copy).pdf", PLAIN), (2016, "Ordinance No. 0118-16.pdf", AMENDING), (2016, "Ordinance No. 0135-16.pdf", BARE),
    (2016, "Ordinance No. 0230-10.pdf", OUT_OF_WINDOW), (2016, "Ordinance No. 0301-16.pdf", SIGNED), (2016, "Ordinance No. 0512-16.pdf", CUE_BEFORE_BREAK), (2016, "Ordinance No. 0999-16.pdf", None),
]


def frame(spark, rows=None):
    import hashlib

    from statutor.sources.documents import CONTRACT

    data = [(y, n, f"data/raw/{y}/{n}", t, "Digital", 1, 0, hashlib.sha256((t or "").encode()).hexdigest()) for y, n, t in (ALL if rows is None else rows)]
    return spark.createDataFrame(data, CONTRACT)
