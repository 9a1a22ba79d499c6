"""Hosts and paths written apart from the words of the labelled table: what filters block, and what they leave alone, with names that only look bad."""

UNWANTED = """
onlyfans-leaks.com/a xvideos.com/video1 redtube.com/12 hentai-world.net/gallery thepiratebay.org/search 1337x.to/home sildenafil-shop.com/buy buy-xanax.net/order
pagead2.googlesyndication.com/pagead/js taboola.com/newsroom cash-advance24.com/apply pornhub.com/view youporn.com/watch xhamster.com/videos xnxx.com/search chaturbate.com/female
livejasmin.com/en camsoda.com/room stripchat.com/girls sexstories69.com/s1 adultfriendfinder.com/go nudecelebs.org/a milfzone.net/p eroticmassage-guide.com/x escortguide-paris.com/list
bet365.com/sports betway-bonus.net/promo williambets.com/odds 888casino.com/play pokerstars.eu/download royalpokerclub.net/join jackpotcity-casino.com/slots superslots.ag/spin
roulette77.us/free bingo-bonanza.co.uk/win lotteryworld24.com/tickets casinorewards-vip.com/go betsonline-now.com/live sportsbetting-tips.biz/today blackjackpro.net/play freeslots4u.com/games
viagra-generic.biz/order cialis-now.net/buy cheappills24.com/shop rx-meds-online.com/cart tramadol-overnight.com/order steroids-for-sale.net/shop weightlosspills-x.com/now pharmacy-pills.top/rx
adserver.example-ads.net/js doubleclick.net/ad popads.net/serve ads.adnetwork-one.com/banner clicktracker24.com/r trackerpixel.io/p.gif ad-track.metrics-ads.com/px adclicks-network.biz/go
banner-exchange-ads.com/show pop-up-ads.info/x phishing-bank-login.com/secure malware-free-download.info/exe scam-lottery-winner.com/claim paydayloans-fast.com/apply quick-loans-payday.net/now getrichquick-crypto.com/join
spammerkit.net/buy free-iphone-giveaway.win/claim warez-bb.org/forum torrentz2.eu/search extratorrents.cc/top keygen-crack.net/app crackedapps-warez.com/dl nulledscripts.to/theme
replicawatches-shop.com/rolex replica-handbags-cheap.com/bag fakewatches4u.net/buy yts-torrents.mx/movie limetorrents-proxy.info/browse sexcams-free.tv/room hotsexvideos.club/1 freepornclips.net/a
xxxvideos-hub.com/w nudes-archive.net/b erotic-cams.live/c adult-toys-xxx.com/d escortservice-london.co.uk/e fetish-world.net/f hookup-tonight-sex.com/g camgirls-live.xxx/h
casino-bonus-777.com/i gamblingwins.net/j online-betting-king.com/k slotsmania-jackpot.com/l pokerbonus-club.org/m onlinecasinos-top.com/n bestroulette-casino.com/o betting-odds-live.com/p
""".split()
CLEAN = """
stackoverflow.com/questions/1 essex.ac.uk/courses sussex.gov.uk/council middlesex.edu/admissions trackandfield.org/results slotcar-racing.com/tracks scaffolding-supplies.co.uk/quote wikipedia.org/wiki/Casino
nytimes.com/2020/politics bbc.co.uk/news theguardian.com/books python.org/docs github.com/apache/spark arxiv.org/abs/1706 nature.com/articles gutenberg.org/files
nasa.gov/missions harvard.edu/about imdb.com/title openstreetmap.org/node allrecipes.com/recipe weather.gov/forecast kubernetes.io/docs mayoclinic.org/diseases
tripadvisor.com/Hotel lonelyplanet.com/france reuters.com/world nationalgeographic.com/animals khanacademy.org/math mit.edu/research lemonde.fr/international elpais.com/cultura
spiegel.de/politik corriere.it/cronache asahi.com/articles britannica.com/topic merriam-webster.com/dictionary goodreads.com/book soundcloud.com/tracks bandcamp.com/album
nhs.uk/conditions who.int/health un.org/climate europa.eu/info loc.gov/collections si.edu/museums metmuseum.org/art moma.org/calendar
adidas.com/shoes adsabs.harvard.edu/abs roadsafety.org/advice broadsheet.ie/news leadsmuseum.org/visit downloads.mozilla.org/firefox uploadsupport.com/help threads.net/about
camden.gov.uk/parking cambridge.org/core campusmap.edu/building camping-holidays.com/sites diabetes.org/symptoms alphabetbooks.com/kids betterhealth.vic.gov/food elizabethgaskell.org/house
medlineplus.gov/druginfo medieval-studies.org/paper comedycentral.com/shows remedialmaths.edu/course pixar.com/films sextantnavigation.org/howto wessexarchaeology.co.uk/digs unisexhairdressers.com/prices
asteroidwatch.org/near torrancecity.org/parks nutcrackerballet.org/tickets crackerbarrel.com/menu stripedbass.net/fishing stripe.com/docs clickhouse.com/docs analytics-journal.org/issue
replicationstudies.org/data loanwords-linguistics.org/list cashmere-knitting.com/patterns milfordsound.co.nz/tours escapegardens.org/visit bingley.gov.uk/town pokerville-library.org/hours lottiedolls.com/about
popularmechanics.com/cars populationdata.net/maps trackpad-repair.com/guide soundtracks-review.com/film racetrack-history.org/monza railtrackmaps.co.uk/line bannermansofscotland.org/clan adultlearning.ie/courses
farmersalmanac.com/moon coffeereview.com/roast bicyclemuseum.org/visit harbourlights.org/songs villagehall-bookings.org/hire winterbirds.net/count paperfolding.org/crane openlibrary.org/works
teacherstoolkit.org/lesson riverfish.org/species mountainweather.net/alps churchbells.org/ringing oldmaps.org/sheet cityrecords.gov/births lawreview.edu/issue energycouncil.org/report
""".split()
