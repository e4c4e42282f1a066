"""Classification tables. All values here are fixed values: results depend on them as they are."""

from __future__ import annotations

NO_DNS = "Unknown (No DNS)"
NOT_MAPPED = "Unknown (Not Mapped)"
GOOGLE_NO_DNS = "Google (No DNS)"
PEER_TO_PEER = "Peer to Peer"
ICE = "ICE (STUN/TURN)"
ICE_PEER_ORG = "ICE Peer (Unknown Org)"
ANONYMIZED_ORG = "Other [Anonymized U<5]"
AGGREGATED_ORG = "Aggregated (Users < 5)"
HINET = "emome-ip.hinet.net"

# Substrings that mark a domain as Google's or Facebook's.
GOOGLE_MARKS = (
    "google", "gmail", "ytimg", "youtube", "gstatic.com", "ggpht.com", "app-measurement.com",
    "gvt1.com", "ampproject", "crashlytics.com", "2mdn.net", "doubleclick.net", "1e100.net",
    "gvt2.com",
)
FACEBOOK_MARKS = ("fbcdn", "facebook", "fbsbx", "fb.com", "accountkit.com")

# Google sub-categories; a pattern must match from the start of the name and the
# last pattern that matches decides.
GOOGLE_PATTERNS = (
    (r"^www\.google\..*$", "Non-video Content"),
    (r"^google\..*$", "Non-video Content"),
    (r"^apis.google.com$", "API"),
    (r"^.*app-measurement\.com$", "API"),
    (r"^suggestqueries\.google\.com$", "API"),
    (r"^www\.googleapis\.com$", "API"),
    (r"^maps\.googleapis\.com$", "API"),
    (r"^mobilemaps-pa\.googleapis\.com$", "API"),
    (r"^geomobileservices.*\.googleapis\.com$", "API"),
    (r"^semanticlocation.*\.googleapis\.com$", "API"),
    (r"^cloudconfig\.googleapis\.com$", "API"),
    (r"^footprints-pa\.googleapis\.com$", "API"),
    (r"^clientservices\.googleapis\.com$", "API"),
    (r"^voledevice-pa\.googleapis\.com$", "API"),
    (r"^.*translate.*\.com$", "API"),
    (r"^chromefeedcontentsuggestions-pa.googleapis.com$", "API"),
    (r"^.*crashlytics\.com$", "API"),
    (r"^phonedeviceverification-pa\.googleapis\.com$", "API"),
    (r"^safebrowsing\.googleapis\.com$", "API"),
    (r"^mdh-pa\.googleapis\.com$", "API"),
    (r"^mobilenetworkscoring-pa\.googleapis\.com$", "API"),
    (r"^firebaseremoteconfig\.googleapis\.com$", "API"),
    (r"^android-safebrowsing\.google\.com$", "API"),
    (r"^fonts\.googleapis\.com$", "API"),
    (r"^dns\.google.*$", "API"),
    (r"^people-pa\.googleapis\.com$", "API"),
    (r"^id\.google\..*$", "Authentication"),
    (r"^accounts\.google\..*$", "Authentication"),
    (r"^clients.*\.google\..*$", "Authentication"),
    (r"^cryptauthenrollment\.googleapis\.com$", "Authentication"),
    (r"^(?:(?!ytimg).)*googleusercontent\.com$", "Non-video Content"),
    (r"^(?:(?!connectivitycheck).)*gstatic\.com", "Non-video Content"),
    (r"^(?:(?!yt).)*ggpht\.com$", "Non-video Content"),
    (r"^(?:(?!beacons).)*\.gvt[0-9]*\.com$", "Mixed CDN"),
    (r"^beacons.*gvt[0-9]*\.com$", "API"),
    (r"^connectivitycheck\.gstatic\.com$", "API"),
    (r"^android\.clients\.google\.com$", "Software or Updates"),
    (r"^play\.googleapis\.com$", "Software or Updates"),
    (r"^android\.googleapis\.com$", "Software or Updates"),
    (r"^dl\.google\.com$", "Software or Updates"),
    (r"^playatoms-pa\.googleapis\.com$", "Software or Updates"),
    (r"^update\.googleapis\.com$", "Software or Updates"),
    (r"^play\.google\.com$", "Software or Updates"),
    (r"^.*googlevideo\.com$", "Video"),
    (r"^.*ytimg.*$", "Video"),
    (r"^.*youtube.*$", "Video"),
    (r"^yt.*\.ggpht\.com$", "Video"),
    (r"^video\.google\..*$", "Video"),
    (r"^.*\.doubleclick\.net$", "Ad Network"),
    (r"^.*googlesyndication\.com$", "Ad Network"),
    (r".*2mdn\.net", "Ad Network"),
    (r"^.*googletagservices\.com", "Ad Network"),
    (r"^.*googletagmanager\.com$", "Ad Network"),
    (r".*analytics.*", "Ad Network"),
    (r".*adservice.*", "Ad Network"),
    (r"^datasaver\.googleapis\.com$", "Compressed Web"),
    (r"^.*ampproject\.org$", "Compressed Web"),
    (r"^.*ampproject\.net$", "Compressed Web"),
    (r"^googleweblight\.com$", "Compressed Web"),
    (r"^litepages\.googlezip\.net$", "Compressed Web"),
    (r"^ampcid\.google\..*$", "Compressed Web"),
    (r"^backup\.googleapis\.com$", "Files"),
    (r"^proxy\.googlezip\.net$", "Files"),
    (r"^drive\.google\.com$", "Files"),
    (r"^photos\.googleapis\.com$", "Content Upload"),
    (r"^compress\.googlezip\.net$", "Content Upload"),
    (r"^photosdata-pa\.googleapis\.com$", "Content Upload"),
    (r"^.*content-storage-upload\.googleapis\.com$", "Content Upload"),
    (r"^mail\.google\.com$", "Messaging"),
    (r"^inbox\.google\.com$", "Messaging"),
    (r"^hangouts\.google\..*$", "Messaging"),
    (r"^.*mtalk.*\.google\.com$", "API"),
    (r"^instantmessaging-pa\.googleapis\.com$", "Messaging"),
    (r"^.*gmail\.com$", "Messaging"),
)
# Used when none of the Google patterns matches.
GOOGLE_FALLBACK = (r"^.*googleapis\.com", "API")
GOOGLE_RENAMED = {"Authentication": "API"}

# Facebook sub-categories, read like the Google ones.
FACEBOOK_PATTERNS = (
    (r"^.*www\.facebook\.com$", "Social Media"),
    (r"^web\.facebook\.com$", "Social Media"),
    (r"^facebook\.com$", "Social Media"),
    (r"^m\.facebook\.com$", "Social Media"),
    (r"^mobile\.facebook\.com$", "Social Media"),
    (r"^.*video.*\.facebook\.com$", "Video"),
    (r"^.*video.*\.fbcdn\.net$", "Video"),
    (r"^static.*\.fbcdn\.net$", "Non-video Content"),
    (r"^static.*\.facebook\.com$", "Non-video Content"),
    (r"^z-m-static.*\.fbcdn\.net$", "Non-video Content"),
    (r"^.*scontent.*\.fbcdn\.net$", "Non-video Content"),
    (r"^lookaside.*\.facebook\.com$", "Non-video Content"),
    (r"^platform-lookaside.*\.fbsbx\.com$", "Non-video Content"),
    (r"^.*api\.facebook\.com$", "API"),
    (r"^.*graph\.facebook\.com$", "Social Media"),
    (r"^portal\.fb\.com$", "API"),
    (r"^connect\.facebook\.net$", "Authentication"),
    (r"^connect\.facebook\.com$", "Authentication"),
    (r"^.*accountkit\.com$", "Authentication"),
    (r"^fbsbx\.com$", "Mixed CDN"),
    (r"^cdn.fbsbx.com$", "Mixed CDN"),
    (r"^edgeray.*\.facebook\.com$", "Mixed CDN"),
    (r"^edge-star.*\.facebook\.com$", "Mixed CDN"),
    (r"^external.*\.fbcdn\.net$", "Mixed CDN"),
    (r"^z-m-external.*\.fbcdn\.net$", "Mixed CDN"),
    (r"^snaptu.*\.facebook\.com$", "Compressed Web"),
    (r"^edge-snaptu.*\.facebook\.com$", "Compressed Web"),
    (r"^.*upload.*\.facebook\.com$", "Content Upload"),
    (r"^.*upload.*\.fbcdn\.com$", "Content Upload"),
    (r"^.*upload.*\.fbcdn\.net$", "Content Upload"),
    (r"^lithium.*\.facebook\.com$", "Ad Network"),
    (r"^an\.facebook\.com$", "Ad Network"),
    (r"^mqtt.*\.facebook\.com$", "Messaging"),
    (r"^.*edge-mqtt.*\.facebook\.com$", "Messaging"),
    (r"^.*edge-chat\.facebook\.com$", "Messaging"),
    (r"^edge-stun.*\.facebook\.com$", "Messaging"),
    (r"^stun.*\.facebook\.com$", "Messaging"),
    (r"^edge-turnservice.*\.facebook\.com$", "Messaging"),
    (r"^whatsapp.*\.fbcdn\.net$", "Messaging"),
    (r"^.*whatsapp.*\.facebook\.com$", "Messaging"),
    (r"^instagram.*\.fbcdn\.net", "Social Media"),
    (r"^instagram.*\.facebook\.com", "Social Media"),
)
FACEBOOK_RENAMED = {
    "Mixed CDN": "Social Media",
    "Non-video Content": "Social Media",
    "Authentication": "API",
}

# All other domains, (organisation, category, substrings). The first row decides
# of which any substring occurs; a pair of substrings in brackets must both occur.
DOMAIN_RULES = (
    ("WhatsApp", "Messaging", ("whatsapp",)),
    ("Twitter", "Video", (("twimg", "video"), ("twitter", "video"))),
    ("Twitter", "Social Media", ("twimg", "twitter")),
    ("Instagram", "Social Media", ("instagram",)),
    ("Wikipedia", "Non-video Content", ("wikipedia",)),
    ("Amazon Web Services", "IAAS", ("amazonaws", "aws.com")),
    ("Amazon", "Non-video Content", ("amazon",)),
    ("818 Religious Conference", "Video", ("livestream818.com",)),
    ("Local Services", "Local Services", ("network.bokondini",)),
    ("Local Services", "Local Services", ("content.bokondini",)),
    ("xvideos", "Adult Video", ("xvideos-cdn.com", "xvideos.com")),
    ("xnxx", "Adult Video", ("xnxx-cdn.com", "xnxx.com")),
    ("TRG Games", "Games", ("trggames.com",)),
    ("Oppo", "API", ("nearme.com.cn",)),
    ("Oppo", "Software or Updates", ("coloros.com",)),
    ("Oppo", "Software or Updates", ("oppomobile.com",)),
    ("IgameCJ", "Games", ("igamecj.com", "file-igamecj.akamaized.net")),
    ("Vivo", "Software or Updates", ("vivoglobal.com", "vivo.com")),
    ("Vidio", "Video", ("vidio.com", "vidio-com.akamaized.net", "vidio.static6.com")),
    ("Tudoo", "Video", ("tudoo.mobi",)),
    ("TikTok", "Video", ("tiktokcdn.com", "tiktokv.com", "muscdn.com", "tiktokcdn-com",
                         "byteoversea.com", "musical.ly")),
    ("TopBuzz", "Mixed CDN", ("topbuzzcdn.com",)),
    ("PHN CDN", "Mixed CDN", ("phncdn.com",)),
    ("RQ Mob", "Ad Network", ("rqmob.com",)),
    ("PUBG", "Games", ("pubgmobile.com",)),
    ("W Share It", "Video", ("wshareit.com",)),
    ("Samsung", "Software or Updates", ("samsungdm.com",)),
    ("Microsoft (non-azure)", "Software or Updates", ("windowsupdate.com",)),
    ("Microsoft (non-azure)", "Software or Updates", ("dl.delivery.mp.microsoft.com",)),
    ("Microsoft (non-azure)", "Software or Updates", ("officecdn.microsoft.com.edgesuite.net",)),
    ("Microsoft (non-azure)", "Software or Updates", ("download.microsoft.com",)),
    ("Azure (Microsoft)", "IAAS", ("azure",)),
    ("Tokopedia", "Non-video Content", ("tokopedia.net",)),
    ("UC Browser", "Software or Updates", ("9appsdownloading.com", "9appsinstall.com")),
    ("UC Browser", "Compressed Web", ("ucweb.com",)),
    ("Liftoff", "Ad Network", ("liftoff.io",)),
    ("Avatar Tracker", "Ad Network", (("avatar.", ".com"),)),
    ("VMate", "Video", ("v-mate.mobi",)),
    ("HiNet", "IAAS", ("emome-ip.hinet.net",)),
    ("Likee", "Video", ("like.video", "bigo.sg", "likeevideo.com", "like-video.com")),
    ("HLSPlay", "Video", ("hlssrv.com",)),
    ("Opera Mini", "Compressed Web", ("opera-mini.net", "operacdn.com", "transcoder.opera.com",
                                      "mobile.opera.com")),
    ("Im-Gb", "Compressed Web", ("im-gb.com",)),
    ("VidMateFilm", "Video", ("img.vidmatefilm.org",)),
    ("VideoX", "Adult Video", ("videoxcdn.net",)),
    ("Bioskopview", "Video", ("bioskopview.com",)),
    ("Adcolony", "Ad Network", ("adcolony.com",)),
    ("Fembed", "Video", ("www2090.o0-5.com",)),
    ("Cootek", "Mixed CDN", ("cootek.com",)),
    ("Unity Ads", "Ad Network", ("unityads.unity3d.com",)),
    ("Samsung", "Software or Updates", ("az-dn.gw.samsungapps.com",)),
    ("Hiido", "Files", ("hiido.com",)),
    ("Shopee", "Non-video Content", ("cf.shopee.co.id", "shopeemobile.com", "shopee.co.id")),
    ("Amplitude", "Ad Network", ("amplitude.com",)),
    ("iVideoSmart", "Ad Network", ("ivideosmart.com",)),
    ("Mangatoon", "Non-video Content", ("mangatoon.100sta.com", "mangatoon.mobi",
                                        "mangatoon.akamaized.net")),
    ("UshareIt", "Files", ("ushareit",)),
    ("Avast", "Antivirus", ("au.ff.avast.com",)),
    ("Symantic", "Antivirus", ("symantecliveupdate.com",)),
    ("Microsoft", "Antivirus", ("definitionupdates.microsoft.com",)),
    ("McAfee", "Antivirus", ("mcafee.com",)),
    ("Tenor", "Non-video Content", ("tenor.co",)),
    ("Giphy", "Non-video Content", ("giphy.com",)),
    ("QQ", "Messaging", ("qq.com", "myqcloud.com")),
    ("Idn View", "Video", ("idnview.com",)),
    ("Joox", "Non-video Content", ("joox.com",)),
    ("Baca", "Non-video Content", ("baca.co.id",)),
    ("Weather CN", "Non-video Content", ("weathercn.com",)),
    ("Vungle", "Ad Network", ("vungle.com",)),
    ("iPrimus", "IAAS", ("iprimus.net.au",)),
    ("cdn syy", "Mixed CDN", ("cdnsyy.com",)),
    ("Uodoo", "Non-video Content", ("uodoo.com",)),
    ("AppLovin", "Ad Network", ("applovin.com",)),
    ("ShareIt Games", "Games", ("shareitgames.com",)),
    ("AdJust", "Ad Network", ("adjust.com",)),
    ("WapTrick", "Non-video Content", ("waptrick.org",)),
    ("Idtribun", "Games", ("idtribun.com",)),
    ("Topwin", "Video", ("topwin-movie-maker.com",)),
    ("ID Kasino", "Games", ("idkasino.com",)),
    ("Moloco", "Ad Network", ("adsmoloco.com",)),
    ("Menangtoto", "Games", ("menangtoto.pw",)),
    ("RdtCDN", "Mixed CDN", ("ev.rdtcdn.com",)),
    ("Boy 18", "Adult Video", ("boy18tube.com",)),
    ("CDN Collection", "Games", ("cdncollection.com",)),
    ("MoPub", "Ad Network", ("mopub.com", "snipermob.com")),
    ("Vidmate", "Video", ("vidmate.net", "vidmatefilm.org")),
    ("Mozilla", "Software or Updates", ("cdn.mozilla.net",)),
    ("Pkvn", "Games", ("pkvn.mobi",)),
    ("Supersonic Games", "Games", ("ssacdn.com",)),
    ("Pinterest", "Non-video Content", ("pinimg.com", "pinterest")),
    ("CaraGeo", "Files", ("carageo.com",)),
    ("MajorGeeks", "Software or Updates", ("majorgeeks.com",)),
    ("Slatic", "Non-video Content", ("slatic.net",)),
    ("Mediatek", "Software or Updates", ("download.mediatek.com",)),
    ("Adobe", "Software or Updates", ("download.adobe.com",)),
    ("Rdt CDN", "Mixed CDN", ("rdtcdn.com",)),
    ("Linode", "IAAS", ("linode.com",)),
    ("Bukalapak", "Non-video Content", ("bukalapak.com",)),
    ("Adtilt", "Ad Network", ("adtilt.com",)),
    ("Feedify", "Ad Network", ("feedify.net",)),
    ("Snapchat", "Video", ("snapchat.com",)),
    ("Alibaba CDN", "Mixed CDN", ("alicdn.com",)),
    ("KS Mobile", "Software or Updates", ("ksmobile.com",)),
    ("Unruly Media", "Ad Network", ("unrulymedia.com",)),
    ("Blogspot", "Non-video Content", ("blogspot.com",)),
    ("Akamai", "Mixed CDN", ("akamai",)),
    ("AWS Cloudfront", "Mixed CDN", ("cloudfront",)),
    ("Cloudflare", "Mixed CDN", ("cloudflare",)),
    ("SN China", "API", ("snssdk.com",)),
    ("Xiaomi", "Software or Updates", ("xiaomi.com",)),
)

# Addresses, (organisation, category, how the text must match, texts); the first
# row decides. The QQ row can never decide: its address also matches the Likee row.
ADDRESS_RULES = (
    ("Facebook", NOT_MAPPED, "contains", ("157.240.25.", "157.240.24.", "157.240.2.")),
    ("Likee", "Video", "contains", ("164.90.115.", "164.90.78.", "169.136.70.", "169.136.65.")),
    ("Kabel Mediacom", NOT_MAPPED, "contains", ("202.80.222.",)),
    ("QQ", "Messaging", "contains", ("169.136.65.204",)),
    ("UCloud", "Games", "contains", ("107.150.124.", "23.248.162.")),
    ("Google", GOOGLE_NO_DNS, "startswith", ("74.125.", "173.194.")),
    ("Digital Ocean", "IAAS", "contains", ("104.248.148.225",)),
    ("Level3", "IAAS", "contains", ("8.37.232.4",)),
    ("Quantil Networks", "Mixed CDN", "startswith", ("168.235.199.",)),
)

# Names of well-known ports by transport protocol number.
PORT_NAMES = {
    6: {22: "SSH", 25: "SMTP", 53: "DNS", 80: "HTTP", 143: "IMAP", 220: "IMAP", 443: "HTTPS",
        993: "IMAP", 5349: "STUN/TURN TLS"},
    17: {53: "DNS", 80: "HTTP/3 (QUIC)", 123: "NTP", 143: "IMAP", 443: "HTTP/3 (QUIC)",
         3478: "STUN/TURN"},
}
OTHER_PORTS = {6: "Other TCP", 17: "Other UDP"}
OTHER_PROTOCOL = "Other"
