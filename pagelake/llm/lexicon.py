"""Word lists of the eleven languages the text operators know.  Fixed values."""

from __future__ import annotations

import re

LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "ru", "ja")

STOP = {
    "en": "the a an of and to in is that for it was with on as are be this not but from they which by or at its one has have had will can you we our their his her when then than so if no all more there been were who what about into up out only while does do how",
    "de": "der die das und in zu den von mit ist nicht im auf für dem des ein eine einer einem es sich als auch aus nach wie sie er wir man wird wurden sind nur oder aber bei an so um haben hat war dass noch wenn denn am",
    "fr": "le la les de des et en un une dans pour que qui du au aux est ne pas sur par ce ces il elle nous vous plus tout mais ou avec sont ont a été se sa son leur car d l y quand on cela",
    "es": "el la los las de y que en un una por para con del al es no se su sus lo más pero como ha han sido todos porque hay esto cuando también o todo entre antes",
    "pt": "o a os as de da do das dos e que em no na nos nas um uma para com por não se seu mais mas como foi foram são todos porque há isto quando também ou ao à é pelo pela tudo",
    "it": "il lo la i gli le di del della dei che e in un una per con non si è sono da dal dalla al alla ma come anche più stati tutti perché ci quando o nel nella alcuni solo questo questi",
    "nl": "de het een van en in op te dat is niet met voor zijn aan die er om door naar bij ook als maar dan nog wel niet wordt werden wie ze ons deze alleen enkele want of uit",
    "sv": "och att det i en ett som på är av för med till den de inte om har var vi från men så när under efter bara alla man ska än några dessa våra eller ut vid",
    "pl": "i w na z się nie do że to jest jak po o od przez dla za są być co tylko ich ale też już gdy kto może wszystkie tych oraz czy bo niektóre nasze ze",
    "ru": "и в на не что с по из к у за это как но для от все они она он его их так же был были или если когда кто ещё уже только потому том находятся некоторые эти",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと です ます この その ため よう まだ すべて では など",
}
STOPWORDS = {k: frozenset(v.split()) for k, v in STOP.items()}
ALL_STOP = frozenset().union(*(v for k, v in STOPWORDS.items() if k != "ja"))

# Short labels of site menus (fixed values, by language).
NAV_LABELS = frozenset(
    x.strip()
    for x in (
        "home, about us, offers, contact, news, help, guides, basket, downloads, blog, careers, sign in, log in, search, menu, shop, products, services, faq, archive, sitemap, contact us, about, login, register, account,"
        "startseite, über uns, angebote, kontakt, neuigkeiten, hilfe, warenkorb, anmelden,"
        "accueil, à propos, nos offres, nous écrire, actualités, aide, panier, connexion,"
        "inicio, quiénes somos, ofertas, contacto, noticias, ayuda, carrito, entrar,"
        "início, sobre nós, promoções, fale connosco, notícias, ajuda, carrinho, iniciar sessão,"
        "pagina iniziale, chi siamo, offerte, scrivici, notizie, aiuto, carrello, accedi,"
        "voorpagina, over ons, aanbiedingen, schrijf ons, nieuws, hulp, winkelmandje, inloggen,"
        "förstasidan, om oss, erbjudanden, skriv till oss, nyheter, hjälp, varukorg, logga in,"
        "strona główna, o nas, oferta, napisz do nas, aktualności, pomoc, koszyk, zaloguj się,"
        "главная, о нас, предложения, связаться, новости, помощь, корзина, войти,"
        "ホーム, 私たちについて, お買い得, お問い合わせ, お知らせ, ヘルプ, 買い物かご, ログイン"
    ).split(",")
    if x.strip()
)

# Boilerplate cues of single lines, matched on lower-cased, space-collapsed text without markup.
_CUES = (
    # consent
    r"\bcookies?\b(?! and scripts)|\bkakor\b|クッキー|small files on your device|choose which trackers|privacy matters to us",
    r"^(?:accept all|manage choices|reject all|alle akzeptieren|einstellungen verwalten|tout accepter|gérer mes choix|accetta tutto|gestisci le preferenze|aceptar todo|gestionar preferencias|aceitar todos|gerir preferências|alles toestaan|voorkeuren beheren|godkänn alla|hantera val|zaakceptuj wszystkie|zarządzaj ustawieniami|принять все|настроить выбор|すべて許可|設定を変更)$",
    # dates of change
    r"^(?:last updated|updated on|bijgewerkt op|mis à jour le|aggiornato il|ändrad den|изменено|atualizado em|zmieniono dnia|zuletzt geändert am|actualizado el|最終更新)(?:$|[ :]).{0,24}$",
    # subscription
    r"join our mailing list|sign up for the|weekly digest|never miss an update|when you subscribe|free articles left|notre lettre|нашу рассылку|nyhetsbrev|nostra lettera|nieuwsbrief|rundbrief|biuletynu|nosso boletim|nuestro boletín|newsletter|お便りに ?登録",
    # sharing
    r"^(?:share this (?:page|article|post)|tell others about this|liked it\? pass it on|send by e-mail|print this page|copy link to clipboard|diesen beitrag mit|partager cet article|condividi questo articolo|comparte este artículo|partilhe este artigo|deel dit bericht|dela den här artikeln|podziel się tym|поделитесь этой|この記事を友だち)",
    # page furniture
    r"^(?:estimated reading time|back to top|skip to (?:main )?content|jump to navigation|report a problem with this|was this page helpful|\d[\d., ]* comments?$|\d[\d., ]* people found this|advertisement$|scripts are switched off, so comments|please enable javascript to see the comments)",
    # legal
    r"trademarks belong to|supplied for guidance only|(?:©|\bcopyright\b|\(c\)) ?\d{4}|\d{4} .{1,60}– ?(?:all rights|alle rechte|tous droits|todos los|todos os|tutti i|alle rechten|alla rätt|wszelkie prawa|все права|無断)|(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|todos os direitos reservados|tutti i diritti riservati|alle rechten voorbehouden|alla rättigheter förbehållna|wszelkie prawa zastrzeżone|все права защищены|無断転載)|earns a small commission|opinions are those of the authors|is a trading name of|no part of this page may be|prices include tax; delivery|complaints should be sent in writing|^(?:terms of use and|mentions légales|villkor och integritet|regulamin i prywatność|impressum und|note legali|условия и конф|aviso jurídico|voorwaarden en privacy|利用規約|aviso legal)",
)
CUE_RE = re.compile("|".join(f"(?:{c})" for c in _CUES))
# Headings of link blocks that lead away from the page.
RELATED_RE = re.compile(
    r"^(?:most read|related articles|related posts|you may also like|recommended for you|more from this section|elsewhere on the site|läs även|lees ook|à lire aussi|das könnte sie auch|читайте также|leggi anche|przeczytaj także|こちらもどうぞ|también te puede|leia também)"
)
# Bylines: a preposition of authorship and one to three capitalised names, nothing else.
_NAME = r"[^\W\d_][^\W\d_'’.]*(?:[-'’][^\W\d_]+)*\.?"
BYLINE_RE = re.compile(
    rf"^(?:(?:by|written by|von|par|por|di|door|av|autor:|автор:|auteur:)\s+|(?:文|著者)[・:：]\s*){_NAME}(?:\s+{_NAME}){{1,2}}$", re.I
)
